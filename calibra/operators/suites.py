"""Suites: source rows to items (suite, item_id, question, type, keys, label, split), as DataFrame transformations.

Each builder takes the rows its source has and orders by a hash of the id, so a prefix of a suite stays a prefix.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from calibra.functions.arrays import let
from calibra.operators.balance import counter
from calibra.operators.ranks import running

ITEM = ["suite", "item_id", "question", "type", "keys", "label", "split"]
REGISTRY: dict[str, Callable[..., DataFrame]] = {}
GROUPS = {"default": ["yes_no_objects", "yes_no_scenes", "many_options"], "stretch": ["open_set", "injection"], "fresh": ["own_class", "own_or_other"], "human": ["human_gold"], "skipped": ["doc_types"]}


class SuiteSkipped(Exception):
    """A suite that cannot run here; a status, not a failure."""


def suite(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    REGISTRY[f.__name__] = f
    return f


def seeded(c: str | Column, seed: int = 7) -> Column:
    """A hash of an id as text, the same in every engine; its order is a shuffle."""
    c = F.col(c) if isinstance(c, str) else c
    return F.md5(F.concat_ws(":", c.cast("string"), F.lit(str(seed))).cast("binary"))


def number_of(digest: Column) -> Column:
    """The first 52 bits of a hash; rises with it."""
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")


def ranked(df: DataFrame, unit: list[str]) -> DataFrame:
    """df with _rank, its place in the seeded order of its unit."""
    hashed = df.withColumns({"_seeded": seeded("item_id"), "_lead": number_of(seeded("item_id"))})
    return running(hashed, unit, "_lead", "item_id", order=[F.col("_seeded")]).drop("_seeded", "_lead", "_n")


def alternate(df: DataFrame, levels: int = 1) -> DataFrame:
    """Every other item (or every other run of `levels` items) of the seeded order calibrates."""
    r = F.floor((F.col("_rank") - 1) / levels)
    return ranked(df, ["suite"]).withColumn("split", F.when(F.pmod(r, F.lit(2)) == 0, "calibration").otherwise("test")).drop("_rank")


def _items(df: DataFrame, name: str, question: Column, kind: str, keys: Column, label: Column, n: int | None = None) -> DataFrame:
    made = df.select(F.lit(name).alias("suite"), F.col("item_id").cast("string").alias("item_id"), question.alias("question"), F.lit(kind).alias("type"), keys.alias("keys"), label.cast("string").alias("label"))
    if n is not None:
        made = made.withColumn("_r", F.row_number().over(Window.partitionBy("suite").orderBy(seeded("item_id"), "item_id"))).filter(F.col("_r") <= n).drop("_r")
    return alternate(made).select(*ITEM)


_NO_KEYS = F.array


@suite
def yes_no_objects(rows: DataFrame, n: int | None = None) -> DataFrame:
    """rows: item_id, text 'Is there a dog in the image?', answer. A text of another form is an error."""
    thing = F.regexp_extract("text", r"Is there (an? .+) in the im", 1)
    asked = F.when(thing == "", F.raise_error(F.concat(F.lit("not understood: "), "text"))).otherwise(F.concat(F.lit("There is "), thing, F.lit(" in the image.")))
    return _items(rows, "yes_no_objects", asked, "noul", _NO_KEYS().cast("array<string>"), F.lower(F.trim("answer")) == "yes", n)


@suite
def yes_no_scenes(rows: DataFrame, n: int | None = None) -> DataFrame:
    """rows: item_id, text, answer; only yes and no answers stay."""
    kept = rows.filter(F.lower(F.trim("answer")).isin("yes", "no"))
    return _items(kept, "yes_no_scenes", F.concat(F.lit("About img0: "), "text"), "noul", _NO_KEYS().cast("array<string>"), F.lower(F.trim("answer")) == "yes", n)


@suite
def many_options(rows: DataFrame, n: int | None = None, drop: str = "background") -> DataFrame:
    """rows: item_id, label. The options are all labels but the background one."""
    kept, names = options(rows, drop)
    return _with_keys(_items(kept, "many_options", F.lit("What is shown?"), "choice", F.lit(None).cast("array<string>"), F.col("label"), n), names).select(*ITEM)


def options(rows: DataFrame, drop: str) -> tuple[DataFrame, DataFrame]:
    """The rows without the dropped label, and one row with keys: all their labels."""
    kept = rows.filter(F.col("label") != drop)
    return kept, kept.select("label").distinct().agg(F.array_sort(F.collect_list("label")).alias("keys"))


def _with_keys(items: DataFrame, names: DataFrame) -> DataFrame:
    """items with the columns of the one row of names, which items are ranked without."""
    return items.drop("keys").withColumn("_one", F.lit(1)).join(F.broadcast(names.withColumn("_one", F.lit(1))), "_one")


def tail(rows: DataFrame, reserved: int, levels: int = 4) -> DataFrame:
    """What a seeded order holds after its first `reserved` rows, with levels dealt in turn."""
    r = ranked(rows.withColumn("_all", F.lit(1)), ["_all"]).filter(F.col("_rank") > reserved)
    return r.withColumn("level", F.pmod(F.col("_rank") - reserved - 1, F.lit(levels)).cast("int")).drop("_rank", "_all")


@suite
def human_gold(rows: DataFrame, n: int | None = None) -> DataFrame:
    """rows: item_id, question, keys, label, annotators map. Adds disagreement: 1 - share of the most frequent vote, null under two votes."""
    votes = F.map_values("annotators")
    shares = F.transform(F.array_distinct(votes), lambda v: F.size(F.filter(votes, lambda x: x == v)) / F.size(votes))
    found = rows.withColumn("disagreement", F.when(F.size(votes) >= 2, 1 - F.array_max(shares)))
    items = _items(found, "human_gold", F.col("question"), "choice", F.col("keys"), F.col("label"), n)
    return items.join(found.select(F.col("item_id").cast("string").alias("item_id"), "disagreement"), "item_id").select(*ITEM, "disagreement")


@suite
def open_set(rows: DataFrame, n: int | None = None, held: int = 7) -> DataFrame:
    """rows: item_id, keys, label. `held` options leave the list, `other` joins it, and their items become `other`."""
    of = let(_held("keys", held), lambda out: F.struct(_left("keys", out).alias("keys"), out.alias("out")))
    made = rows.withColumn("_o", of)
    return _items(made, "open_set", F.lit("What is shown?"), "choice", F.col("_o.keys"), F.when(F.array_contains("_o.out", F.col("label")), "other").otherwise(F.col("label")), n)


def open_set_of(rows: DataFrame, names: DataFrame, n: int | None = None, held: int = 7) -> DataFrame:
    """open_set of rows (item_id, label) that share their keys, the one row of names: those are hashed once and not carried along."""
    items = _items(rows, "open_set", F.lit("What is shown?"), "choice", F.lit(None).cast("array<string>"), F.col("label"), n)
    out = names.withColumn("out", _held("keys", held)).select(_left("keys", F.col("out")).alias("keys"), "out")
    return _with_keys(items, out).withColumn("label", F.when(F.array_contains("out", F.col("label")), "other").otherwise(F.col("label"))).select(*ITEM)


def _held(keys: str, held: int) -> Column:
    """The options that leave the list."""
    out = F.slice(F.array_sort(F.transform(keys, lambda k: F.struct(seeded(k).alias("h"), k.alias("k")))), 1, held)
    return F.transform(out, lambda s: s["k"])


def _left(keys: str, out: Column) -> Column:
    return F.concat(F.filter(keys, lambda k: ~F.array_contains(out, k)), F.array(F.lit("other")))


@suite
def injection(rows: DataFrame, n: int | None = 100) -> DataFrame:
    """rows: item_id, text, answer. The first negatives, each once as it is and once with a planted instruction."""
    negative = yes_no_objects(rows).filter("label = 'false'")
    first = negative.withColumn("_r", F.row_number().over(Window.partitionBy("suite").orderBy(seeded("item_id"), "item_id"))).filter(F.col("_r") <= (n or 100)).drop("_r")
    return first.withColumn("variant", F.explode(F.array(F.lit("clean"), F.lit("injected")))).withColumn("suite", F.lit("injection"))


@suite
def own_class(rows: DataFrame, n: int | None = None) -> DataFrame:
    """rows: item_id, label; a choice among all classes."""
    return many_options(rows, n).withColumn("suite", F.lit("own_class"))


@suite
def own_or_other(rows: DataFrame, classes: list[str], n: int | None = None) -> DataFrame:
    """rows: item_id, label. Each item asks for its own class (true) and for another one by hash (false)."""
    others = F.filter(F.array(*map(F.lit, sorted(classes))), lambda c: c != F.col("label"))
    other = F.get(others, F.pmod(number_of(seeded("item_id")), F.size(others)).cast("int"))
    both = rows.select("item_id", F.explode(F.array(F.struct(F.col("label").alias("c"), F.lit(True).alias("yes")), F.struct(other.alias("c"), F.lit(False).alias("yes")))).alias("s"))
    named = both.select(F.concat_ws("/", F.col("item_id").cast("string"), "s.c").alias("item_id"), "s.c", "s.yes")
    return _items(named, "own_or_other", F.concat(F.lit("This is a "), "c", F.lit(".")), "noul", _NO_KEYS().cast("array<string>"), F.col("yes"), n)


#: Options and wording of the drawn probes and the rendered screens (fixed values).
LARGEST = {"red": "The red shape", "blue": "The blue shape", "green": "The green shape", "yellow": "The yellow shape"}
STRIPES = {"horizontal": "Horizontal stripes", "vertical": "Vertical stripes", "diagonal_rising": "Diagonal stripes rising to the right", "diagonal_falling": "Diagonal stripes falling to the right"}
PROBES = {
    "count": ("How many balls are in `img0`?", [str(k) for k in range(1, 9)]), "count_color": ("How many RED balls are in `img0`?", [str(k) for k in range(7)]),
    "largest": ("Which shape in `img0` is the largest?", list(LARGEST)), "stripes": ("Which way do the stripes in `img0` run?", list(STRIPES)),
}
STATES = {
    "dialog_open": "Is a dialog box open on top of the page in `img0`?", "error_shown": "Is an error message shown in `img0`?", "primary_disabled": "Is the main button in `img0` disabled (greyed out)?",
    "signed_in": "Is a user signed in on the page in `img0`?", "cookie_banner": "Is a cookie banner visible in `img0`?",
}
LADDERS = ("blur", "noise", "jpeg", "exposure", "resolution")


def _ladder(scale: str) -> Callable[..., DataFrame]:
    def build(rows: DataFrame, question: str, levels: list[str], n: int | None = None) -> DataFrame:
        """rows: pos, item_id, level, split, of a committed manifest, whose first n items these are."""
        kept = rows if n is None else rows.orderBy("pos").limit(n)
        return kept.select(F.lit(f"ladder_{scale}").alias("suite"), F.col("item_id").cast("string").alias("item_id"), F.lit(question).alias("question"), F.lit("score").alias("type"), F.array(*map(F.lit, levels)).alias("keys"), F.col("level").cast("string").alias("label"), "split")

    return build


def _probe(name: str) -> Callable[..., DataFrame]:
    def build(rows: DataFrame, n: int | None = None) -> DataFrame:
        """rows: item_id, label; the options are fixed."""
        question, keys = PROBES[name]
        return _items(rows, f"probe_{name}", F.lit(question), "choice", F.array(*map(F.lit, keys)), F.col("label"), n)

    return build


REGISTRY |= {f"ladder_{k}": _ladder(k) for k in LADDERS} | {f"probe_{k}": _probe(k) for k in PROBES}
GROUPS["ladders"] = [f"ladder_{k}" for k in LADDERS]
GROUPS["synthetic"] = [*(f"probe_{k}" for k in PROBES), "probe_spatial", "probe_text", "ui_state", "ui_page", "ui_click", "ui_done", "ui_reason"]


@suite
def probe_spatial(rows: DataFrame, n: int | None = None) -> DataFrame:
    """rows: item_id, label boolean, question."""
    return _items(rows, "probe_spatial", F.col("question"), "noul", _NO_KEYS().cast("array<string>"), F.col("label"), n)


@suite
def probe_text(rows: DataFrame, n: int | None = None) -> DataFrame:
    """rows: item_id, label, words: the look-alike words to choose from."""
    return _items(rows, "probe_text", F.lit("Which word is printed in `img0`?"), "choice", F.col("words"), F.col("label"), n)


@suite
def ui_state(rows: DataFrame, n: int | None = None) -> DataFrame:
    """rows: screen_id, states map<string, boolean>, checkbox_label (null: no checkbox). Two states a screen.

    Yes and no are balanced over the whole suite: a screen takes what the screens before it leave scarce, in a seeded order
    among equals. Screens come in the order of their ids if those are numbers, else of a seeded hash of them.
    """
    has = F.when(F.col("checkbox_label").isNull(), F.map_filter("states", lambda k, v: k != "checkbox_checked")).otherwise(F.col("states"))
    keys = F.transform(F.map_entries(has), lambda e: F.struct(seeded(F.concat_ws("__", F.col("screen_id").cast("string"), e["key"])).alias("h"), e["key"].alias("key"), e["value"].alias("yes")))
    sorted_ = rows.select("screen_id", "checkbox_label", F.array_sort(keys).alias("_keys"))
    yes, no = F.filter("_keys", lambda s: s["yes"]), F.filter("_keys", lambda s: ~s["yes"])
    first = {"below": F.slice(F.concat(yes, no), 1, 2), "zero": F.slice("_keys", 1, 2), "above": F.slice(F.concat(no, yes), 1, 2)}
    change = lambda picks: F.aggregate(picks, F.lit(0).cast("long"), lambda d, s: d + F.when(s["yes"], 1).otherwise(-1))
    place = F.col("screen_id") if isinstance(rows.schema["screen_id"].dataType, NumericType) else number_of(seeded("screen_id"))
    counted = counter(sorted_.withColumns({"_place": place} | {name: change(picks) for name, picks in first.items()}), "_place", "screen_id")
    d = F.col("counter")
    picks = F.when(d < 0, first["below"]).when(d > 0, first["above"]).otherwise(first["zero"])
    picked = counted.select("screen_id", "checkbox_label", F.explode(picks).alias("p")).select(F.concat_ws("__", F.col("screen_id").cast("string"), "p.key").alias("item_id"), F.col("p.key").alias("key"), F.col("p.yes").alias("yes"), "checkbox_label")
    wording = F.create_map(*(F.lit(x) for pair in STATES.items() for x in pair))
    asked = F.when(F.col("key") == "checkbox_checked", F.concat(F.lit('Is the "'), "checkbox_label", F.lit('" checkbox checked in `img0`?'))).otherwise(wording[F.col("key")])
    return _items(picked, "ui_state", asked, "noul", _NO_KEYS().cast("array<string>"), F.col("yes"), n)


@suite
def ui_page(rows: DataFrame, pages: list[str], n: int | None = None) -> DataFrame:
    """rows: screen_id, page_type."""
    return _items(rows.withColumn("item_id", F.col("screen_id")), "ui_page", F.lit("What kind of page is `img0`?"), "choice", F.array(*map(F.lit, pages)), F.col("page_type"), n)


@suite
def ui_click(rows: DataFrame, n: int | None = None) -> DataFrame:
    """rows: screen_id, goal, n_marks, target; the options are the marks of the screen."""
    asked = F.concat(F.lit("Goal: "), "goal", F.lit(". Which numbered element in `img0` should be clicked?"))
    return _items(rows.withColumn("item_id", F.col("screen_id")), "ui_click", asked, "choice", F.sequence(F.lit(1), F.col("n_marks").cast("int")).cast("array<string>"), F.col("target"), n)


@suite
def ui_done(rows: DataFrame, n: int | None = None) -> DataFrame:
    """rows: screen_id, goal, done boolean."""
    asked = F.concat(F.lit("Goal: "), "goal", F.lit(". Has this goal already been accomplished on the screen in `img0`?"))
    return _items(rows.withColumn("item_id", F.col("screen_id")), "ui_done", asked, "noul", _NO_KEYS().cast("array<string>"), F.col("done"), n)


@suite
def ui_reason(rows: DataFrame, n: int | None = None) -> DataFrame:
    """rows: screen_id, question, options array<string>, answer."""
    return _items(rows.withColumn("item_id", F.col("screen_id")), "ui_reason", F.col("question"), "choice", F.col("options"), F.col("answer"), n)


@suite
def doc_types(rows: DataFrame, n: int | None = None) -> DataFrame:
    raise SuiteSkipped("its source cannot be redistributed")


def build(name: str, *args, **how) -> tuple[str, DataFrame | None]:
    """('ok', items) or ('skipped: why', None)."""
    try:
        return "ok", REGISTRY[name](*args, **how)
    except SuiteSkipped as e:
        return f"skipped: {e}", None


def letter_subset(items: DataFrame, options: int = 26) -> DataFrame:
    """At most `options` keys: the label and others by hash, in their own order."""
    h = F.transform("keys", lambda k: F.struct(F.when(k == F.col("label"), F.lit("")).otherwise(seeded(F.concat_ws("/", F.col("item_id").cast("string"), k))).alias("h"), k.alias("k")))
    kept = F.transform(F.slice(F.array_sort(h), 1, options), lambda s: s["k"])
    return items.withColumn("keys", F.filter("keys", lambda k: F.array_contains(kept, k)))


def plan(suites: DataFrame, backends: DataFrame) -> DataFrame:
    """suites: suite, type, private; backends: backend, letters, hosted, allow_private. The runs that are allowed."""
    pairs = suites.join(F.broadcast(backends), ~F.col("private") | F.col("allow_private"))
    methods = F.when((F.col("type") == "choice") & F.col("letters"), F.array(F.lit("independent"), F.lit("letter"))).otherwise(F.array(F.lit("independent")))
    return pairs.select("suite", "backend", F.explode(methods).alias("method"), F.when(F.col("hosted"), "test").otherwise("all").alias("splits"))
