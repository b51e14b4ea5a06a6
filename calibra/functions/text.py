"""Column functions on prompts, answers, identifiers and logs."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_LETTERS = 26


def candidate(key: Column, description: Column) -> Column:
    """The description, or the key with blanks for underscores where there is none."""
    return F.when(F.length(description) > 0, description).otherwise(F.replace(key, F.lit("_"), F.lit(" ")))


def prompt_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def lettered(options: Column) -> Column:
    """One line for each option: A. first, B. second; more than 26 is an error."""
    lines = F.transform(options, lambda o, i: F.concat(F.char(i + 65), F.lit(". "), o))
    return F.when(F.size(options) > MAX_LETTERS, F.raise_error(F.lit("more than 26 options"))).otherwise(F.array_join(lines, "\n"))


def scale(levels: Column, backwards: bool = False) -> Column:
    """Numbered scale lines, from 0 up or from the top down."""
    lines = F.transform(levels, lambda o, i: F.concat(i.cast("string"), F.lit(": "), o))
    return F.array_join(F.reverse(lines) if backwards else lines, "\n")


def image_ids(text: Column) -> Column:
    """Distinct names between backticks, in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("`([^`]+)`"), F.lit(1)))


def referenced_image(text: Column, known: Column) -> Column:
    """The one known image a question names; the only image when it names none; null where that is not clear."""
    named = F.array_intersect(image_ids(text), known)
    return F.when(F.size(named) == 1, F.get(named, F.lit(0))).when((F.size(named) == 0) & (F.size(known) == 1), F.get(known, F.lit(0)))


def first_allowed(text: Column, allowed: list[str]) -> Column:
    """The allowed word that stands first in a written answer, as a whole word; null if none does."""
    places = F.array(*(F.struct(F.regexp_instr(F.lower(text), F.lit(rf"(?<![\p{{L}}\p{{N}}_]){w.lower()}(?![\p{{L}}\p{{N}}_])")).alias("at"), F.lit(w).alias("word")) for w in allowed))
    return F.array_min(F.filter(places, lambda x: x["at"] > 0))["word"]


def json_answer(text: Column, field: str) -> Column:
    """A whole-number field of the outermost braces of a text; null unless it is an integer there."""
    v = F.try_parse_json(F.regexp_extract(text, r"(?s)\{.*\}", 0))
    kind = F.schema_of_variant(F.try_variant_get(v, f"$.{field}", "variant"))
    return F.when(kind == "BIGINT", F.try_variant_get(v, f"$.{field}", "bigint"))


#: What looks like an API key (fixed value).
KEY_LIKE = r"(sk|key|AIza)[-_A-Za-z0-9*.]{8,}"


def scrub(text: Column, secret: str | None = None) -> Column:
    """text without the secret, if given, and without anything shaped like a key."""
    if secret:
        text = F.replace(text, F.lit(secret), F.lit("<api-key>"))
    return F.regexp_replace(text, KEY_LIKE, "<api-key>")


def safe_name(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\p{L}\p{N}._-]", "_")


def html_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def run_id(ts: Column, config: Column) -> Column:
    return F.concat(F.date_format(ts, "yyyyMMdd'T'HHmmss'Z'"), F.lit("-"), F.substring(F.sha2(config, 256), 1, 6))


#: The digits of request ids (fixed value).
BASE32 = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def base32(value: Column, length: int) -> Column:
    """The lowest 5 * length bits of a long (60 at most) as characters that sort as the numbers do."""
    digit = lambda k: F.substring(F.lit(BASE32), F.shiftright(value, 5 * k).bitwiseAND(F.lit(31)).cast("int") + 1, F.lit(1))
    return F.concat(*(digit(k) for k in reversed(range(length))))


def request_id(millis: Column, entropy: Column | None = None) -> Column:
    """An id that sorts by time: 48 bits of milliseconds and 80 random bits, the first 20 of 32 or more hex digits."""
    entropy = F.sha2(F.uuid(), 256) if entropy is None else entropy
    random = [base32(F.conv(F.substring(entropy, 5 * g + 1, 5), 16, 10).cast("long"), 4) for g in range(4)]
    return F.concat(F.lit("req_"), base32(millis, 10), *random)


def json_scalar(value: Column, ascii_only: bool = False) -> Column:
    """One value as JSON; null is `null`. With ascii_only, other characters become \\uXXXX."""
    text = F.to_json(F.struct(value.alias("v")))
    text = F.when(value.isNull(), "null").otherwise(F.substring(text, 6, 1 << 30).substr(F.lit(1), F.length(text) - 6))
    if not ascii_only:
        return text
    escape = lambda n: F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(n), 4, "0")))
    high = lambda n: F.lit(0xD800) + F.shiftright(n - 0x10000, 10)
    low = lambda n: F.lit(0xDC00) + (n - 0x10000).bitwiseAND(F.lit(0x3FF))
    each = F.transform(F.split(text, ""), lambda c: F.when(F.ascii(c) < 128, c).when(F.ascii(c) < 0x10000, escape(F.ascii(c))).otherwise(F.concat(escape(high(F.ascii(c))), escape(low(F.ascii(c))))))
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.array_join(each, "")).otherwise(text)


def canonical_json(values: dict[str, Column], ascii_only: bool = False) -> Column:
    """An object with sorted names, `, ` and `: ` between; values are scalars, or arrays of strings."""

    def shown(name: str, v: Column) -> Column:
        return F.concat(F.lit(f'"{name}": '), json_scalar(v, ascii_only))

    parts = [shown(k, v) for k, v in sorted(values.items())]
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


def json_strings(values: Column, ascii_only: bool = False) -> Column:
    """An array of strings as JSON, `, ` between."""
    return F.concat(F.lit("["), F.array_join(F.transform(values, lambda v: json_scalar(v, ascii_only)), ", "), F.lit("]"))


def key_hash(canonical: Column) -> Column:
    """12 hex digits of a configuration's canonical JSON; a version is its kind and the first 6 of them."""
    return F.substring(F.sha2(canonical, 256), 1, 12)


def key_version(canonical: Column, kind: str = "cal") -> Column:
    return F.concat(F.lit(f"{kind}_"), F.substring(F.sha2(canonical, 256), 1, 6))
