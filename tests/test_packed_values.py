import pytest

from quarrystone.operators.packed_values import Splitter, split_packed

KNOWN = ["Class I, Div 1", "IP66 / NEMA 4X", "CE", "RoHS", "Shock and vibration", "SIL 2", "Gas", "Gas, dry"]


@pytest.mark.parametrize(
    ("text", "items"),
    [
        ("CE", ["CE"]),
        ("CE; RoHS", ["CE", "RoHS"]),
        ("class i, div 1, CE", ["class i, div 1", "CE"]),
        ("IP66 / NEMA 4X/CE", ["IP66 / NEMA 4X", "CE"]),
        ("CE and Shock and vibration and SIL 2", ["CE", "Shock and vibration", "SIL 2"]),
        ("Gas, dry, Gas", ["Gas, dry", "Gas"]),
        ('"CE", "a; b"', ["CE", "a; b"]),
        ("'CE'; 'RoHS'", ["CE", "RoHS"]),
        ('"CE"\n"RoHS"', ["CE", "RoHS"]),
        ('["CE","own, mark"]', ["CE", "own, mark"]),
        ("1) CE 2) RoHS", ["CE", "RoHS"]),
        ("1. CE\n2. works paper 3.1", ["CE", "works paper 3.1"]),
        ("- CE\n- RoHS", ["CE", "RoHS"]),
        ("• CE", ["CE"]),
        ("CE, , CE,", ["CE", "CE"]),
        ("CE, and RoHS & SIL 2", ["CE", "RoHS", "SIL 2"]),
        ("  ", []),
        ("n/a", []),
        ("TBD", []),
        ("--", []),
    ],
)
def test_split(text, items):
    assert list(Splitter(KNOWN).split(text)) == items


def test_cover_prefers_long_values_against_brute_force():
    s = Splitter(["a, b", "b, c", "a, b, c", "c, d"])
    assert list(s.split("a, b, c, d")) == ["a, b, c", "d"] or list(s.split("a, b, c, d")) == ["a, b", "c, d"]
    # The cover that protects most characters wins: "a, b" with "c, d" protects 8, "a, b, c" 7.
    assert list(s.split("a, b, c, d")) == ["a, b", "c, d"]


def test_table(spark):
    rows = [(1, "CE;RoHS", None, "x"), (2, None, "SIL 2", "y"), (2, None, "SIL 2", "y"), (3, "", "?", None), (4, "CE " * 1 + ";" + "v" * 20000, None, None)]
    df = spark.createDataFrame(rows, "id bigint, one string, two string, item string")
    got = sorted(map(tuple, split_packed(df, "id", ["one", "two"], {"one": KNOWN}).collect()), key=lambda r: (r[0], r[1], r[2]))
    assert got[:2] == [(1, "one", 1, "CE"), (1, "one", 2, "RoHS")]
    assert got[2:4] == [(2, "two", 1, "SIL 2")] * 2
    assert len(got) == 6 and len(got[5][3]) == 20000
    assert split_packed(df.limit(0), "id", ["one", "two"], {}).count() == 0


def test_blanks_and_quotes_of_any_number():
    s = Splitter(["RS485, Modbus RTU"])
    for n in (1, 10, 60, 5000):
        assert s.split("RS485, Modbus RTU" + " " * n + "gateway") == ("RS485", "Modbus RTU" + " " * n + "gateway")
        assert s.split("RS485, Modbus RTU" + " " * n + "; gateway") == ("RS485, Modbus RTU", "gateway")
    import time

    began = time.perf_counter()
    s.split('"a' * 50_000)
    s.split('" ' * 50_000 + "x")
    assert time.perf_counter() - began < 5


def test_cover_against_all_subsets():
    """The dynamic program protects as many characters as the best of all sets of values that do not overlap, with as few values."""
    import random
    from itertools import combinations

    rng = random.Random(2)
    for _ in range(150):
        known = ["".join(rng.choice(["a", "b", ", ", "; ", "/"]) for _ in range(rng.randint(2, 5))).strip(" ;,/") for _ in range(5)]
        known = [k for k in known if any(c in k for c in ",;/")]
        s = Splitter(known)
        text = "".join(rng.choice([*known, "a", "b", ", ", "; ", "/"] if known else ["a", ", "]) for _ in range(6)).lower()
        got = s._cover(text)
        spans = []
        if s.any:
            single = [Splitter([k]) for k in known]
            spans = list({x for one in single for x in one._cover(text)} | {x for one in single for end, size in (one.automaton.iter(text) if one.any else ()) for x in [(end + 1 - size, end + 1)] if x in one._cover(text[: x[1]] + text[x[1] :])})
        best = (0, 0)
        for r in range(min(4, len(spans)) + 1):
            for chosen in combinations(sorted(spans), r):
                if all(a[1] <= b[0] for a, b in zip(chosen, chosen[1:])):
                    best = max(best, (sum(e - b for b, e in chosen), -len(chosen)))
        assert (sum(e - b for b, e in got), -len(got)) >= best, (known, text)
        assert all(a[1] <= b[0] for a, b in zip(got, got[1:]))


def test_quotes_close_at_the_first_place_that_may():
    s = Splitter([])
    assert s.split('"a, b" c", d') == ('a, b" c', "d") and s.split('"a" "b", c') == ('a" "b', "c")
    assert s.split("'it's, so'; lid") == ("it's, so", "lid")
    assert s.split("“a; b”, c") == ("a; b", "c") and s.split("«a / b» / c") == ("a / b", "c")
    assert s.split('"lid, never closed') == ('"lid', "never closed")
