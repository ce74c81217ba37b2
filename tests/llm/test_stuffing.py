import random

from quarrystone.llm.stuffing import page, shape, shape_report, shares, stuffed_pages

PHRASES = ["gas sensor", "leak tester", "buy sensor online", "h2 monitor"]
PROSE = "The technician moved the probe from the roof to the hall. Unless the unit is sealed, the reading drifts slowly upward.\nWhen the fan runs at half speed, accuracy is no longer guaranteed in the north wing."


def _many(sep, n=40):
    rng = random.Random(1)
    return sep.join(rng.choice(PHRASES) for _ in range(n))


STUFFED = {
    1: _many(", "), 2: _many(" "), 3: _many("\n"), 4: _many(" | "),
    5: "\n".join(f"https://site{k}.example/p/{k}" for k in range(20)),
    6: "\n".join(f"[gas sensor](http://site{k}.example/{k})" for k in range(15)),
    7: "\n".join(f"Home > gas sensor > Wall {'ABCDEFGH'[k % 8]}" for k in range(20)),
    8: " ".join(f"#{p.replace(' ', '_')}" for p in _many(",").split(",")),
    9: " · ".join(f"Brand{'abcdefgh'[k % 8]} Wall QW-{100 + k}" for k in range(25)),
    10: " ".join(f"Looking for {p}? Our {p} is {p} quality. Every {p} buyer needs {p}." for p in ["gas sensor"] * 8),
    11: PROSE + "\n\n" + _many(", ", 60),
    12: "\n".join(f"leak tester Town{'abcdefghij'[k % 10]}" for k in range(20)),
}
FINE = {
    101: PROSE, 102: "\n".join(f"{k}  AB-{100 + k}  steel bracket  qty {k * 7 + 1}" for k in range(1, 30)),
    103: "\n".join(f"2025-05-15 02:{k:02d}:06 reading {k}.5 % v/v at hall" for k in range(10, 40)),
    104: "\n".join(f"Order code: AB-{100 + k} (housing lid)" for k in range(20)),
    105: "\n".join(f"earth stud {'abcdefgh'[k]}: {PROSE.splitlines()[0]}" for k in range(8)),
    106: "\n".join(f"[{k}] {PROSE.splitlines()[0]} https://a{k}.example/x" for k in range(8)),
    107: "\n".join(["Warning: do not open the pump while a radio is keyed nearby."] * 6 + [PROSE]),
    108: PROSE + "\nSee http://a.example/x\nSee http://b.example/y\nTags: gas sensor, leak tester",
    109: "", 110: None, 111: "<|endoftext|>", 112: " ", 113: "x" * 30000,
}


def test_pages(spark):
    rows = [(k, t, "kind") for k, t in {**STUFFED, **FINE}.items()] + [(1, STUFFED[1], "kind")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, shapes string")
    assert sorted(r.doc_id for r in stuffed_pages(df).collect()) == [1, *STUFFED]
    report = shape_report(df).collect()
    assert sum(r.lines for r in report if r.kind == "link") >= 35
    assert stuffed_pages(df.limit(0)).count() == 0


def test_shapes():
    assert shape("The unit is sealed before each shift.")[0] == "sentence"
    assert shape("https://a.example/b")[0] == "link"
    assert shape("Home > Offers > Wall")[0] == "path"
    assert page(None) == (0.0, []) and page("\n \n") == (0.0, [])


def test_phrases_listed_on_few_of_many_pages(spark):
    words = ["wasserstoff sensor", "gasmelder preis", "alarma fija", "capteur gaz", "leckage sucher", "sonda larga", "methan melder", "prix balise"]
    lists = [(k, ", ".join(words)) for k in (1, 2, 3)]
    page_of = (4, " ".join(f"Today {p} helps." for p in words))
    plain = [(k, f"The pump of hall {k} was checked before noon.") for k in range(10, 9010)]
    df = spark.createDataFrame([*lists, page_of, page_of, *plain], "doc_id bigint, text string")
    assert sorted(r.doc_id for r in stuffed_pages(df).collect()) == [1, 2, 3, 4, 4]
    assert {r.doc_id for r in stuffed_pages(df.filter("doc_id <> 3")).collect()} == {1, 2}  # two pages list them: too few
    assert {r.stuffed for r in shares(df.filter("doc_id <= 4")).collect()} == {1.0}


def test_phrases_with_a_word_of_grammar_inside():
    frames = ["Nous {} vendons.", "Ici {} arrive.", "Leur {} brille.", "Chez {} gagne.", "Voyez {} demain.", "Prenez {} bientôt.", "Testez {} chaque.", "Aimez {} toujours."]
    for phrase in ("capteur pas cher", "detector de metano", "prix du capteur", "calibration gas for methane"):
        assert page("\n".join(f.format(phrase) for f in frames))[0] > 0.5


def test_offers_between_stars():
    offers = "\n".join(f"{p.upper()} ★ {p} ★ {k * 7 + 90},- ★ {'NEW' if k % 2 else 'free shipping'}" for k, p in enumerate(PHRASES * 4))
    assert shape(offers.split("\n")[0])[0] == "offer" and page(offers)[0] == 1.0
    assert page("\n".join(f"Probe {k} ★ {k}.5 ppm" for k in range(20)))[0] == 0.0


def test_few_links_have_no_cliff():
    lines = [f"https://site{k}.example/p/{k}" for k in range(12)]
    assert [page("\n".join(lines[:n]))[0] for n in (2, 5, 6, 12)] == [1.0] * 4
    assert page(PROSE + "\n" + "\n".join(lines[:5]))[0] == 0.0  # a few beside sentences


def test_links_with_markup_inside():
    assert shape('<a href="/x"><b>cheap sensor</b></a>')[0] == "link"
    assert shape('<a href="/x"><img src="y.png"></a> <a href="/z">x</a>')[0] == "link"
    assert shape("www.leak.example/a www.leak.example/b.")[0] != "sentence" or shape("www.leak.example/a")[0] == "link"
    import time

    began = time.perf_counter()
    shape("<a " * 30_000)
    shape("<a>" * 30_000)
    shape("[" * 60_000)
    assert time.perf_counter() - began < 5


def test_dominating_shapes_decide(spark, monkeypatch):
    """A page is found by its few most frequent shapes of stuffing; many different shapes of small shares do not dominate."""
    from quarrystone.llm import stuffing

    groups = {("list", f"shape {k}"): [1, 100] for k in range(10)}
    assert stuffing.dominance(1000, groups) == stuffing.FEW_SHAPES * 100 / 1000
    assert stuffing.dominance(1000, {("list", "a"): [5, 300], ("link", "b"): [5, 300], ("sentence", "c"): [1, 400]}) == 0.6
    df = spark.createDataFrame(list(STUFFED.items()), "doc_id bigint, text string")
    monkeypatch.setattr(stuffing, "STUFFING", frozenset())
    assert {k for k, t in STUFFED.items() if stuffing.page(t)[0] > 0.5} <= {2, 10, 11}  # what is in slots
    monkeypatch.setattr(stuffing, "dominance", lambda *a, **k: 0.0)
    assert all(stuffing.page(t)[0] == 0.0 for t in STUFFED.values()) and df.count() == len(STUFFED)


def test_verdict_is_the_same_in_a_larger_corpus(spark):
    own = [*STUFFED.items(), *[(k, t) for k, t in FINE.items() if t]]
    more = [(1000 + k, f"{PROSE} Note {k} of hall {k % 17}.") for k in range(10 * len(own))]
    alone, among = (sorted(r.doc_id for r in stuffed_pages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()) for rows in (own, own + more))
    assert alone == among == list(STUFFED)


def test_shares_against_all_phrases_at_once(spark):
    """The filter, the join and the early decisions give what counting every page with all listed phrases gives."""
    import random

    from pyspark.sql import functions as F

    from quarrystone.llm.stuffing import listed_phrases, page_lines

    rng = random.Random(9)
    lines = [PROSE, _many(", ", 8), _many(" | ", 6), "Order a gas sensor today. The leak tester of hall 3 was sold.", "Spare kit: AB-12 (lid)", "https://a.example/x", "Buy sensor online now, gas sensor tomorrow.", "", "#gas #leak #x", "Overview"]
    rows = [(k, "\n".join(rng.choice(lines) for _ in range(rng.randint(0, 7))) if k % 9 else None) for k in range(120)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    known = frozenset(tuple(r.phrase.split(" ")) for r in listed_phrases(page_lines(df)).collect())
    want = {k: page(t, known)[0] for k, t in rows}
    assert known and {r.doc_id: round(r.stuffed, 9) for r in shares(df).collect()} == {k: round(v, 9) for k, v in want.items()}
    assert sorted(r.doc_id for r in stuffed_pages(df).collect()) == sorted(k for k, v in want.items() if v > 0.5)
    assert df.filter(F.col("doc_id") < 0).count() == 0
