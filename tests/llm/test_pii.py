import hashlib
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tessitura.llm import pii as P

from .conftest import ODD

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    text = text or ""
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out += [("card", *m.span()) for m in CARD.finditer(text) if 16 <= len(digits(m)) <= 19 and P.luhn(digits(m))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m)) <= 15]


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet=st.sampled_from("a@.-1250+() é"), max_size=50))
def test_linear_scans_equal_patterns(text):
    assert P.base_spans(text) == brute(text)


def test_luhn():
    assert P.luhn("4111111111111111") and not P.luhn("4111111111111112")


TEXTS = [
    "mail bob.x@mail1.example.com or +1 (212) 555-0100 now", "card 4111 1111 1111 1111 and ip 10.0.0.255, bad 300.1.1.1 1.2.3.4.5.6.7.8",
    "é漢 ab@cd.ef \U0001f600 x@y", "a@b.c@d.e", "++12 345678901", None, "",
]


def test_base_columns(spark, docs):
    rows = list(enumerate(TEXTS)) + [(100 + i, t) for i, (_, t) in enumerate(ODD)]
    for r in P.personal_data(docs(*rows)).collect():
        want = brute(dict(rows)[r["doc_id"]])
        assert [r[f"n_{k}"] for k in P.KINDS] == [sum(x[0] == k for x in want) for k in P.KINDS]
        assert r["base"] == r["spans"] == ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert hashlib.sha256(r["base"].encode()).hexdigest()
    assert P.personal_data(docs(*rows).limit(0)).count() == 0


def test_contexts_of_seeds_find_unseen_identifiers(spark, docs):
    rng = random.Random(1)
    rows = [(i, f"please call me at +1 (212) 555-{1000 + i} any day") for i in range(8)]
    rows += [(50, "please call me at 212555777 any day"), (51, "the count was 212555778 last year"), (52, "it costs 3 and 4")]
    rows += [(60 + i, f"see page {rng.randrange(10**7, 10**8)} for more") for i in range(5)]
    out = {r["doc_id"]: r for r in P.personal_data(docs(*rows)).collect()}
    a = rows[8][1].index("212")
    assert out[50]["spans"] == f"phone:{a}:{a + 9}" and out[50]["base"] == "" and out[50]["n_phone"] == 0
    assert out[51]["spans"] == out[52]["spans"] == "" and all(out[60 + i]["spans"] == "" for i in range(5))
    assert all(out[i]["spans"] == out[i]["base"] for i in range(8))


def plain_trusted(seen, rounds, support=P.SUPPORT, confidence=P.CONFIDENCE):
    """trusted_contexts() with dicts."""
    edges = {(c, v) for _, v, c in seen}
    seed = {}
    for k, v, _ in seen:
        if k:
            seed[v] = max(k, seed.get(v, k))
    values = {}
    for c, v in edges:
        values.setdefault(c, set()).add(v)
    accepted, before = {v: (k, 1.0) for v, k in seed.items()}, None
    for r in range(rounds):
        trusted = {}
        for c, vs in values.items():
            own = [accepted[v] for v in vs if v in accepted]
            strength = sum(x for _, x in own) / (len(vs) + 1)
            if len(own) >= support and strength >= confidence:
                by_kind = {}
                for k, x in own:
                    by_kind[k] = by_kind.get(k, 0) + x
                trusted[c] = (max(by_kind, key=lambda k: (by_kind[k], k)), strength)
        if r == rounds - 1:
            return trusted
        accepted = {v: (k, 1.0) for v, k in seed.items()}
        for v in {v for _, v in edges} - set(seed):
            own = [trusted[c] for c, x in edges if x == v and c in trusted and trusted[c][0] != "card"]  # 9 digits
            if own:
                rest = 1.0
                for _, x in own:
                    rest *= 1 - x
                accepted[v] = (max(own, key=lambda o: (o[1], o[0]))[0], 1 - rest)
        now = len(accepted), round(sum(x for _, x in accepted.values()), 3)
        if now == before:
            return trusted
        before = now


def test_graph_equals_plain_loop(spark):
    rng = random.Random(3)
    for case in range(3):
        seen = [(rng.choice(["email", "phone", "card"]) if v < 12 else None, f"{10**8 + v}", f"c{c}") for v in range(40) for c in rng.sample(range(12), 3) if rng.random() < 0.8 or v < 12]
        for rounds in (1, 2, 12):
            out = P.trusted_contexts(spark.createDataFrame(seen, "kind string, value string, context string"), rounds, 2, 0.25 + 0.05 * case).collect()
            want = plain_trusted(seen, rounds, 2, 0.25 + 0.05 * case)
            assert {r["context"]: (r["kind"], round(r["confidence"], 9)) for r in out} == {c: (k, round(x, 9)) for c, (k, x) in want.items()}


def test_patterns_without_seeds_come_to_be_trusted(spark, docs):
    """Seeds teach 'call me at'; what it finds teaches 'number is', which finds identifiers of documents without any."""
    rows = [(100 + i, f"please call me at +1 (212) 555-{1000 + i} any day") for i in range(24)]
    rows += [(20 + i, f"please call me at 2125557{70 + i} any day") for i in range(6)]
    rows += [(40 + i, f"my number is 2125557{70 + i}, thanks a{i} b{i}") for i in range(6)]
    rows += [(60, "my number is 998877665 u v"), (61, "the number was 998877664 u w")]
    out = {r["doc_id"]: r["spans"] for r in P.personal_data(docs(*rows)).collect()}
    assert out[60] == "phone:13:22" and out[61] == ""
    assert all(out[20 + i] and out[40 + i] for i in range(6))
    assert {r["doc_id"]: r["spans"] for r in P.personal_data(docs(*rows), rounds=1).collect()}[60] == ""


def test_places_at_the_ends_and_long_words(spark, docs):
    long = "w" * 500
    rows = [(i, f"+1 (212) 555-{1000 + i} tel a{'xyz'[i % 3] * (i + 1)}") for i in range(8)] + [(20, "212555777 tel"), (21, "2125557771111111 tel"), (22, "212555776")]
    rows += [(100 + i, f"a{i} {long}x 10.0.0.{i} {long}") for i in range(8)] + [(120, f"q {long}x 1000009 {long}"), (121, f"q {long}y 1000008 {long}z")]
    out = {r["doc_id"]: r["spans"] for r in P.personal_data(docs(*rows)).collect()}
    assert out[20] == "phone:0:9" and out[21] == out[22] == ""
    assert out[120] == "ip:504:511" and out[121] == ""


def test_patterns_of_a_span():
    text = 'see id="x77" and token = "04de" (+1 555).'
    w = P._Words(text)
    at = lambda part: w.contexts(text.index(part), text.index(part) + len(part))
    assert at("x77") == ['in|id="']
    assert at("04de") == ["before|token ="]
    assert at("+1 555") == ["before|= 0de", "around|0de <end>"]
