from __future__ import annotations

import pytest

from calibra.llm import pii

TEXT = 'mail und.34@mail7.example.com card 9807915762804490, +1 (017) 555-7713 or +1-017-555-7713 at 97.51.17.173. token = "b44e15e09fd311c3cf3163b66d5a9875b883d8ce" Mrs Anna Schmidt met Иван Петров; ssn 123-45-6789; 4111 1111 1111 1111'


@pytest.fixture(scope="module")
def made():
    return pii.Surrogates(b"key")


def test_replaces_all_and_keeps_the_rest(made):
    out, spans, pairs = made.replace(TEXT)
    for _, entity, surrogate in pairs:
        assert entity not in out and surrogate in out and entity != surrogate
    assert [out[a:b] for a, b, _ in spans] == [p[2] for p in pairs]
    assert out.startswith("mail ") and " met " in out and out.count("\n") == TEXT.count("\n")


def test_coreference_and_format(made):
    out = {e: s for _, e, s in made.replace(TEXT)[2]}
    digits = lambda s: "".join(c for c in s if c.isdigit())
    assert digits(out["+1 (017) 555-7713"]) == digits(out["+1-017-555-7713"])
    assert out["+1 (017) 555-7713"][:4] == "+1 (" and len(out["123-45-6789"]) == 11
    assert pii._luhn(digits(out["4111 1111 1111 1111"])) and not pii._luhn(out["9807915762804490"])
    assert out["Anna Schmidt"].split()[0] in pii.GIVEN["latin", "f"] and out["Иван Петров"].split()[0] in pii.GIVEN["cyrillic", "m"]
    assert made.make("ANNA@X.COM", "email") == made.make("anna@x.com", "email").upper().replace("COM", "COM")
    assert pii.Surrogates(b"other").make("a.b@c.de", "email") != made.make("a.b@c.de", "email")


@pytest.mark.parametrize(("kind", "values"), [("phone", [f"+1 (017) 555-{i:04d}" for i in range(500)]), ("email", [f"a{i}@b.co" for i in range(500)]), ("ip", [f"10.0.{i % 2}.{i // 2}" for i in range(500)]), ("number", [f"{i:016d}" for i in range(500)]), ("name", [n for g in pii.GIVEN.values() for n in g] + ["Xuria", "Bo Li", "Bo La"]), ("ssn", [f"{i:03d}-00-0001" for i in range(500)])])
def test_distinct(made, kind, values):
    out = [made.make(v, kind) for v in values]
    assert len({o.casefold() for o in out}) == len(values)
    assert not any(a == b for a, b in zip(values, out))


def test_permutation_is_whole_and_moves_all():
    p = pii.Permuter(b"k")
    for n in (2, 3, 10, 26, 100, 257):
        got = [p(i, n, "t") for i in range(n)]
        assert sorted(got) == list(range(n)) and not any(i == g for i, g in enumerate(got))
    assert p(0, 1, "t") == 0


def test_clean_texts_stay():
    for t in ("", "The year 2024 had 365 days, v1.2.3.", "3.141592653589793", "He paid 1,200,000.", "a @ b", "Ratio 4:3 = 12", "x" * 100_000, "@" * 3000, "1" * 40):
        assert pii.find(t) == []


def test_frames(spark):
    rows = [(1, TEXT, "u"), (2, None, "v"), (3, "", "w"), (1, TEXT, "u"), (None, "mail a@b.co", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, note string")
    got = pii.pseudonymize(df, b"key").collect()
    assert [r["note"] for r in got] == list("uvwux") and got[0] == got[3]
    assert got[1]["text"] is None and got[1]["pii_spans"] == [] and got[2]["text"] == ""
    assert pii.pseudonymize(df.limit(0), b"key").count() == 0
    assert pii.collisions(df, b"key").count() == 0
    with pytest.raises(ValueError):
        pii.pseudonymize(df.withColumnRenamed("note", "pii_spans"), b"key")


@pytest.mark.parametrize(("kind", "values"), [
    ("name", ["王小明", "李小", "李大", "محمد", "محمود", "דוד", "İpek", "Ipek", "İİ", "Çğ", "김철수", "ŽŽ", "ẞẞ", "ΝΙΚΟΣ", "ꙀꙀ"]),
    ("email", ["用户@例子.com", "用户@例孑.com", "ñ@ñ.es", "١@٢.com"]), ("secret", ["========", "=======.", "--------"]),
    ("number", ["٤١١١١١١١١١١١١١١١", "٤١١١١١١١١١١١١١١٢", "4111111111111111"]), ("ssn", ["१२३-४५-६७८९"]),
])
def test_no_entity_stays_in_any_script(made, kind, values):
    out = [made.make(v, kind) for v in values]
    assert len({o.lower() for o in out}) == len(values) and not any(a == b for a, b in zip(values, out, strict=True))
    for a, b in zip(values, out, strict=True):
        assert len(a) == len(b) and all(c.isalnum() == d.isalnum() and c.isdecimal() == d.isdecimal() for c, d in zip(a, b, strict=True))


def test_classes_are_a_partition():
    classes = pii._all_classes()
    assert all(c in k and len(k) > 1 for c, k in classes.items()) and sum(map(len, set(classes.values()))) == len(classes)


def test_names_of_other_scripts_are_found_and_moved(made):
    for name in ("王小明", "محمد", "İpek"):
        out, spans, _ = made.replace(f"met Dr. {name}, today")
        assert len(spans) == 1 and name not in out and out.startswith("met Dr. ") and out.endswith(", today")


def test_query_reports_collisions(spark, tmp_path):
    spark.createDataFrame([(1, "Dr. 王小明 and a@b.co"), (2, "Dr. 李小 and c@b.co"), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [r["n_collisions"] for r in pii.op5_pii_surrogates(spark, str(tmp_path)).collect()] == [0, 0, 0]


FOUND = [
    ("fe80::1ff:fe23:4567:890a is up", "fe80::1ff:fe23:4567:890a", "ip6"), ("at 2001:0db8:0000:0000:0000:ff00:0042:8329.", None, None), ("[2001:db8::8a2e:370:7334]:443", "2001:db8::8a2e:370:7334", "ip6"),
    ("x eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.dozjgNryP4J3jVmNHl0w5N y", "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.dozjgNryP4J3jVmNHl0w5N", "secret"),
    ("use xoxb-123456789012-abcdefGHIJ now", "xoxb-123456789012-abcdefGHIJ", "secret"), ("glpat-ABCdef1234567890abcd", "glpat-ABCdef1234567890abcd", "secret"),
    ("call 0171 2345678 today", "0171 2345678", "phone"), ("Tel. 030/1234 567", "030/1234 567", "phone"), ("le 01 23 45 67 89.", "01 23 45 67 89", "phone"),
    ("my name is Xiaoming Wang.", "Xiaoming Wang", "name"), ("Kind regards,\nOlu Adeyemi", "Olu Adeyemi", "name"), ("ich heiße Björk Öz,", "Björk Öz", "name"), ("a\nName: Garcia Lopez\n", "Garcia Lopez", "name"),
]


@pytest.mark.parametrize(("text", "entity", "kind"), FOUND)
def test_more_kinds_are_found_whole(made, text, entity, kind):
    got = [(text[a:b], k) for a, b, k in pii.find(text)]
    assert entity is None or got == [(entity, kind)]
    out, _, pairs = made.replace(text)
    assert all(p[1] not in out for p in pairs)


@pytest.mark.parametrize("text", ["a[1::2] and b[10::20]", "std::be ad::dead", "12:30:45", "aa:bb:cc:dd:ee:ff", "on 01-02-2023 12:30 or 01/02/2023", "0.123 456 789", "the file name: Report A", "0001 0002 000", "Brief by hand, best regards to all", "::1 and ::"])
def test_likenesses_stay(text):
    assert pii.find(text) == []


def test_addresses_keep_kind_and_spelling(made):
    import ipaddress

    out = {v: made.make(v, "ip6") for v in ("2001:db8::1", "2001:0db8:0000:0000:0000:0000:0000:0001", "2001:DB8::1", "fe80::1", "fd00::5", "ff02::fb", "::ffff:0:1", "4000::1")}
    same = {ipaddress.IPv6Address(out[v]) for v in ("2001:db8::1", "2001:0db8:0000:0000:0000:0000:0000:0001", "2001:DB8::1")}
    assert len(same) == 1 and len(out["2001:0db8:0000:0000:0000:0000:0000:0001"]) == 39 and out["2001:DB8::1"].upper() == out["2001:DB8::1"]
    for v, o in out.items():
        assert ipaddress.IPv6Address(v) != ipaddress.IPv6Address(o)
        assert [ipaddress.IPv6Address(v) in n for n in pii._KINDS] == [ipaddress.IPv6Address(o) in n for n in pii._KINDS]
    many = {made.make(f"fe80::{i:x}", "ip6") for i in range(400)}
    assert len(many) == 400
    found, _, pairs = made.replace("from 2001:db8:0:0:0:0:0:1 to 2001:db8::1")
    assert pairs[0] == pairs[1] and len(found.split()) == 4


def test_tokens_keep_their_prefix_and_stay_apart(made):
    values = [f"{p}{i:020d}abcd" for p in ("ghp_", "xoxb-", "sk-", "eyJ", "qqz_") for i in range(200)]
    out = [made.make(v, "secret") for v in values]
    assert len({o.lower() for o in out}) == len(values) and not set(out) & set(values)
    for v, o in zip(values, out, strict=True):
        start = pii._PREFIX.match(v)
        assert (pii._PREFIX.match(o) or [None])[0] == (start[0] if start else None)


def test_national_numbers_stay_national_and_apart(made):
    values = [f"0171 {i:07d}" for i in range(300)] + [f"555-123-{i:04d}" for i in range(300)]
    out = [made.make(v, "phone") for v in values]
    digits = ["".join(c for c in o if c.isdigit()) for o in out]
    assert len(set(digits)) == len(values) and all(d[0] == "0" and d[1] != "0" for d in digits[:300]) and not any(d[0] == "0" and d[1] != "0" and len(d) == 10 for d in digits[300:])
    assert made.make("0171/2345678", "phone").replace("/", " ") == made.make("0171 2345678", "phone")


def test_announced_names_are_found_again(made):
    text = "My name is Xiaoming Garcia. Xiaoming Garcia wrote; Garcia signed; garcia and Garcias stay, Xiaoming too."
    out, spans, pairs = made.replace(text)
    assert [p[1] for p in pairs] == ["Xiaoming Garcia", "Xiaoming Garcia", "Garcia"] and len(spans) == 3
    assert pairs[0][2] == pairs[1][2] and pairs[0][2].endswith(" " + pairs[2][2]) and out.endswith("garcia and Garcias stay, Xiaoming too.")


def test_without_a_setting_the_key_is_random_and_holds_for_the_application(spark, monkeypatch):
    assert not spark.conf.get("spark.calibra.pii.key", None)
    first = pii.key_of(spark)
    assert first == pii.key_of(spark) and len(first) == 32
    monkeypatch.setattr(pii, "_made", {})
    assert pii.key_of(spark) != first
    spark.conf.set("spark.calibra.pii.key", "mine")
    try:
        assert pii.key_of(spark) == b"mine"
    finally:
        spark.conf.unset("spark.calibra.pii.key")


def test_query_equals_the_plain_replacement_of_each_text(spark, tmp_path):
    texts = [TEXT, None, "", *(t for t, _, _ in FOUND), TEXT]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    plain = pii.Surrogates(pii.key_of(spark))
    got = {r["doc_id"]: r for r in pii.op5_pii_surrogates(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        want = (t, []) if t is None else plain.replace(t)[:2]
        assert got[i]["text"] == want[0] and [tuple(s) for s in got[i]["pii_spans"]] == want[1] and got[i]["n_entities"] == len(want[1]) and got[i]["n_collisions"] == 0
