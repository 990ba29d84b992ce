import hashlib
import random
import re

from pagewise.llm import pii, queries

from .helpers import docs, odd_rows

PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(t):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            if k == 0 or k == 1 and all(int(x) <= 255 for x in m[0].split(".")) or k == 2 and 12 <= len(d) <= 19 and luhn(d) or k == 3 and 9 <= len(d) <= 15:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_are_the_patterns():
    rng = random.Random(1)
    for alphabet in ("ab@@..1239_- +", "0123 -456.", "+0123456789 ()-.", "4111 1111-é"):
        for _ in range(4000):
            t = "".join(rng.choices(alphabet, k=rng.randint(0, 60)))
            assert pii.plain_spans(t) == brute(t), t
    card = "4111 1111 1111 1111"
    assert pii.plain_spans(f"x {card} y") == [(2, 2, 21)]


def disguised(t):
    base, spans = pii.find(t)
    assert set(base) <= set(spans)
    return [(pii.KINDS[k], t[a:b]) for a, k, b in spans if (a, k, b) not in base]


def test_disguises_map_back():
    assert disguised("mail john.doe (at) example (dot) com now") == [("email", "john.doe (at) example (dot) com")]
    assert disguised("write to jane at mail dot example dot org please") == [("email", "jane at mail dot example dot org")]
    assert disguised("é jane[at]example.com!") == [("email", "jane[at]example.com")]
    assert disguised("call plus one five five five one two three four five six seven.") == [("phone", "plus one five five five one two three four five six seven")]
    assert disguised("card four one one one one one one one one one one one one one one one ok") == [("card", "four" + " one" * 15)]
    assert disguised("јоhn@exаmple.com") == [("email", "јоhn@exаmple.com")]
    assert disguised("ip 192[.]168[.]1[.]1") == [("ip", "192[.]168[.]1[.]1")]
    assert disguised("one nine two dot one six eight dot one dot one") == [("ip", "one nine two dot one six eight dot one dot one")]
    assert disguised("＋４９ (30) 1234 5678") == [("phone", "＋４９ (30) 1234 5678")]
    assert disguised("mail me john @ example . com or so") == [("email", "john @ example . com")]
    assert disguised("JOHN AT EXAMPLE DOT COM") == [("email", "JOHN AT EXAMPLE DOT COM")]
    assert disguised("card 4lll 1111 1111 1111 x") == [("card", "4lll 1111 1111 1111")] or disguised("card 41l1 1111 1111 1111 x") == [("card", "41l1 1111 1111 1111")]
    assert disguised("at 1O.0.0.l now") == [("ip", "1O.0.0.l")]
    assert disguised("jo​hn@exam​ple.com") == [("email", "jo​hn@exam​ple.com")]


def test_prose_is_left_alone():
    for t in ("to be at the dot of it", "one two three", "look at example.com for more", "meet me at noon. dot the i", "un deux trois points", "we sat at the point in time", "five, six, seven, eight dancers at ten"):
        assert disguised(t) == []


def test_mask():
    assert pii.masked("a@b.co and +1 (743) 555-3824.") == "<email> and <phone>."


def test_long_runs_take_linear_time():
    import time

    for t in ("1" * 100_000, "a" * 100_000, "a@" * 50_000, "+1" * 50_000, "1." * 50_000, "+" + "1 " * 50_000, "one " * 20_000, "(at) " * 20_000, "x at y dot " * 10_000, "а" * 100_000, "a@b.co jane (at) ex (dot) com " * 20_000, "O0 " * 100_000):
        began = time.time()
        pii.find(t)
        assert time.time() - began < 5, t[:10]


def test_rows(spark):
    rows = [*odd_rows(), (50, "é a@b.co 1.2.3.4 and 300.1.1.1"), (51, "+1 (743) 555-3824 4465758382889437")]
    got = pii.digest(docs(spark, rows, clash=True)).collect()
    want = []
    for i, t, *_ in rows:
        b = brute(t)
        named = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in b)
        want.append((i, *(sum(k == n for _, k, _ in b) for n in range(4)), hashlib.sha256(named.encode()).hexdigest(), named))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert pii.digest(docs(spark, rows).limit(0)).count() == 0


def test_query_on_the_tables(spark, sf):
    got = {r["doc_id"]: r for r in queries.op7_personal_data(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        named = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in brute(r["text"]))
        assert got[r["doc_id"]]["base_sha256"] == hashlib.sha256(named.encode()).hexdigest()


def test_disguises_alone_in_a_text_are_read():
    assert disguised("mail john@example .com now") == [("email", "john@example .com")]
    assert disguised("mail john [  at  ] example.com now") == [("email", "john [  at  ] example.com")]
    assert disguised("mail john [\tat\t] example.com now") == [("email", "john [\tat\t] example.com")]
    assert disguised("ip оne nine twо dot one six eight dot оne dot one") == [("ip", "оne nine twо dot one six eight dot оne dot one")]
    assert disguised("ip оne.twо.оne.twо") == [("ip", "оne.twо.оne.twо")]
    assert disguised('ip "one.two.one.two"') == [("ip", "one.two.one.two")]
    assert disguised("at 10.0.0.l now") == [("ip", "10.0.0.l")]


def test_any_host_ending_and_mixed_numbers():
    assert disguised("mail jane at firma dot it, please") == [("email", "jane at firma dot it")]
    assert disguised("jane at firma dot se") == [("email", "jane at firma dot se")]
    assert disguised("jane at firma dot de now") == [("email", "jane at firma dot de")]
    assert disguised("jane at firma dot pl now") == [("email", "jane at firma dot pl")]
    assert disguised("ip 192 dot 168 dot one dot 1 up") == [("ip", "192 dot 168 dot one dot 1")]
    for t in ("look at the dot it makes", "look at a dot in it.", "look at this dot on paper"):
        assert disguised(t) == [], t


def test_planted_disguises_are_found_where_they_stand():
    """Identifiers disguised at random, at known places in prose: each span, and nothing else, comes back."""
    rng = random.Random(9)
    digits = "zero one two three four five six seven eight nine".split()

    def email():
        name, host = "".join(rng.choices("bcdfghjkl", k=6)), "".join(rng.choices("mnpqrstvw", k=5))
        at = rng.choice([" (at) ", "[at]", " at ", " @ ", " { at } "])
        dot = " dot " if at == " at " else " . " if at == " @ " else rng.choice([" (dot) ", "[.]", "."])
        return "email", f"{name}{at}{host}{dot}{rng.choice(['com', 'org', 'pl', 'fr'])}"

    def ip():
        parts = [rng.randint(100, 255) for _ in range(4)]
        way = rng.randrange(3)
        if way == 0:
            return "ip", "[.]".join(map(str, parts))
        if way == 1:
            return "ip", " dot ".join(" ".join(digits[int(c)] for c in str(p)) for p in parts)
        return "ip", " dot ".join(map(str, parts))

    def phone():
        return "phone", "plus " + " ".join(digits[int(c)] for c in "4" + "".join(rng.choices("123456789", k=10)))

    for _ in range(300):
        text, want = "", []
        for _ in range(rng.randint(1, 5)):
            text += " ".join(rng.choices("wood hill lake stone leaf".split(), k=rng.randint(1, 6))) + ", "
            kind, said = rng.choice([email, ip, phone])()
            want.append((kind, len(text), len(text) + len(said)))
            text += said + "; "
        got = [(pii.KINDS[k], a, b) for a, k, b in pii.find(text)[1]]
        assert got == want, text


def test_tape_keeps_the_source_of_every_character():
    import re

    t = pii.Tape("ab--cd--e")
    t.rewrite(re.compile("--"), lambda m: "+").rewrite(re.compile("d"), lambda m: "").rewrite(re.compile("b\\+"), lambda m: "X")
    assert t.text == "aXc+e"
    assert list(zip(t.start.tolist(), t.end.tolist())) == [(0, 1), (1, 4), (4, 5), (6, 8), (8, 9)]
