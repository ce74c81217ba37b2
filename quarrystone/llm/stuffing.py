"""Pages made of search phrases, links, paths, product names or tags instead of sentences or data.

Every line is reduced to a shape: classes of word count, capitals, separators, links, tags, amounts and end marks.
The lines of a page are grouped by shape, and a page is found if its few most frequent shapes that are neither of sentences nor of data
hold more than half of its text. Phrases worked into sentences have a shape of their own: there every word that belongs to a phrase is a slot,
and the text in slots leaves the sentence's shape for that of phrases. Phrases are those that come back between ever other neighbours on the page,
and those that the pages of the whole corpus list one after another.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator, Set

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrystone.session import materialise

#: Short words of grammar; a pair with one of them is no search phrase.
GRAMMAR = set(
    "a an and are as at be been before but by can down e for from g has have if in is it its itself no not of on one only or our out over so than that the then "
    "they this to up was we were when while with within without you your "
    "auf aus bei bis das dem den der des die ein eine einem einen einer für im in ist mit nach nicht oder sich und unter vom von vor wenn wir wird zu zum zur "
    "al antes con cuando de del desde el en es esta este la las lo los no para pasados por que se sin sobre su tras un una y "
    "au aux avec ce ces dans des du elle est et il ils l la le les lorsque même n ne nous ou par pas pour quand qu que sa se ses si son sous sur un une après d "
    "और का की के को कि जब तब तो पर में से है हैं हो हम लिए जाता दिखाता चाहिए बाद करनी".split()
)
LINK = re.compile(r"\[[^\[\]\n]*+\]\([^()\s]*+\)|(?:https?://|www\.)\S+", re.I)
ANCHOR = re.compile(r"<a\b[^<>]*+>", re.I)
ANCHORED = re.compile(r"</a\s*>", re.I)
TAG = re.compile(r"(?<![\w&])#\w[\w\-]*")
PARTING = re.compile(r"[,|;•·*›»>→~\t–—/\-]")
SEPARATOR = re.compile(r"\s*(?:[,|;•·*›»>→~]|\s[–—/\-]\s|\t)\s*")
SENTENCE = re.compile(r"[^.!?。！？।…\n]*+[.!?。！？।…]++[\"')\]”»]*+(?=\s|$|[^\x00-\u024f])|[^.!?。！？।…\n]++|[^\s]")
AMOUNT = re.compile(r"(?<![\w\-])[+\-±]?\d+(?:[.,:]\d+)*(?:\s*%)?(?![\w\-])")
STAMP = re.compile(r"\d{4}-\d\d-\d\d|\d\d:\d\d")
KEYED = re.compile(r"^[^\s:][^:]{0,40}:\s+\S")
WORD = re.compile(r"[^\W_]+-\d\w*|[^\W_][\w\u0900-\u0963\u0966-\u097f]*")
#: What stands between sentences among the words.
PAUSE = "\0"
SPOKEN = re.compile(WORD.pattern + "|" + PAUSE)
MARKS = ".!?。！？।"
MARKED = re.compile(f"[{MARKS}]")
#: What a plain line of sentences does not have.
SPECIAL = re.compile(r"[|;•·*›»>→~#<\[:\t\u2190-\u21ff\u2500-\u27bf\u2b00-\u2bff]")
DASHED = re.compile(r"\s[–—/\-]\s|\d{4}-\d\d-\d\d")
#: Signs that adorn offers and part them.
ADORNED = re.compile(r"\s*[\u2190-\u21ff\u2500-\u27bf\u2b00-\u2bff]+\ufe0f?\s*")
ENDED = re.compile(r"[.!?。！？।…][\"')\]”»]*\s*$")
ARROW, PARTED, INNER = re.compile(r"\s[>›»]\s"), re.compile(r"\s[>›»|/]\s"), re.compile(r"[.!?][\"')]*\s+\S")
#: Fewer links or tags than these, unless they outnumber the sentences of the page two to one, are a few on a page of its own content. So many short
#: lines may be a list.
FEW = 6
#: Shapes that may together dominate a page.
FEW_SHAPES = 3
#: Kinds of shapes that are neither sentences, data nor headings. A few links or tags, and short lines that do not repeat each other's words, are none.
STUFFING = frozenset(("link", "tag", "path", "list", "offer", "phrase", "listing"))


def _bin(n: int) -> str:
    return str(n) if n < 2 else "2-4" if n < 5 else "5-9" if n < 10 else "10+"


def _unlinked(line: str) -> tuple[str, int]:
    """The line without its links, and how many they are. Anchors are told from their ends, so that each part is read once."""
    links = 0
    if "<" in line:
        parts = ANCHORED.split(line)
        for k, part in enumerate(parts[:-1]):
            if m := ANCHOR.search(part):
                parts[k] = part[: m.start()]
                links += 1
        line = " ".join(parts)
    rest, more = LINK.subn(" ", line)
    return rest, links + more


def shape(line: str) -> tuple[str, str]:
    """``(kind, shape)`` of a line; kind is sentence, data, link, tag, path, list, offer or short."""
    if line[-1:] in MARKS and line.count(",") < 3 and not SPECIAL.search(line) and "www." not in line.lower() and not DASHED.search(line):
        # Nothing but words, few commas and an end mark: a sentence or several, as most lines are.
        return "sentence", f"w{_bin(line.count(' ') + 1)} ."
    linked = "<" in line or "[" in line or "://" in line or "www." in line or "WWW." in line or "Www." in line
    rest, links = _unlinked(line) if linked else (line, 0)
    words = WORD.findall(rest)
    n = len(words)
    ended = bool(ENDED.search(rest))
    tags = len(TAG.findall(line)) if "#" in line else 0
    amounts = len(AMOUNT.findall(rest))
    if amounts * 12 >= n and amounts and not links and tags < 2 and rest.isascii() and (not ended or STAMP.search(rest)):
        return "data", f"w{_bin(n)} n+"  # whatever its separators
    segments = len([s for s in SEPARATOR.split(rest.strip()) if s.strip()]) if PARTING.search(rest) else 1
    adorned = 0 if rest.isascii() else len([s for s in ADORNED.split(rest) if s.strip()])
    capital = sum(map(str.isupper, [w[0] for w in words]))
    look = f"w{_bin(n)} c{'0' if not capital else 'all' if capital == n else 'some'} s{_bin(max(segments, adorned))} l{_bin(links)} t{_bin(tags)} n{'0' if not amounts else '+'}{' .' if ended else ''}"
    if links and n <= 5 * links and not ended:
        kind = "link"
    elif tags >= 2 and n <= 5 * tags:
        kind = "tag"
    elif adorned >= 3 and n <= 5.5 * adorned and not INNER.search(rest):
        kind = "offer"
    elif amounts and (not ended or STAMP.search(rest)) and amounts * 12 >= n:
        kind = "data"
    elif segments < 4 and KEYED.match(rest):
        kind = "sentence" if n > 8 else "data"
    elif segments >= 4 and n <= 5.5 * segments and not INNER.search(rest):
        kind = "path" if ARROW.search(rest) else "list"
    elif segments == 3 and n <= 12 and not ended and PARTED.search(rest):
        kind = "path"
    elif not ended and 0 < n <= 6:
        kind = "short"
    else:
        kind = "sentence"
    return kind, look


def _phrases(lines: Iterable[tuple[str, str]]) -> set[str]:
    """The phrases of two to four words, without numbers, that stand in lines ``(kind, line)`` of list shapes."""
    found: set[str] = set()
    short: list[str] = []
    for kind, line in lines:
        if kind in ("list", "path", "tag", "offer"):
            found.update(s.strip().lower() for s in (ADORNED if kind == "offer" else SEPARATOR).split(re.sub(r"[#_]", " ", line)))
        elif kind == "link":
            found.update(re.sub(r"<[^<>]*+>|\]\([^()]*+\)|https?://\S+|[\[\]:>–-]", " ", line).strip().lower().splitlines())
        elif kind == "short":
            short.append(line.lower())
    if len(short) >= FEW:
        found.update(short)
    each = (WORD.findall(p) for p in found)
    return {" ".join(w) for w in each if 2 <= len(w) <= 4 and w[0] not in GRAMMAR and w[-1] not in GRAMMAR and not any(not x.isalpha() and any(map(str.isdigit, x)) for x in w)}


Groups = dict[tuple[str, str], list[int]]


def _lines(text: str) -> tuple[int, list[str], Groups, list[tuple[str, str]]]:
    """Characters of a text, its prose lines, its shapes with their lines and characters, and its lines ``(kind, line)`` of neither sentences nor data."""
    groups: Groups = defaultdict(lambda: [0, 0])
    prose: list[str] = []
    total, number = 0, Counter()
    short: list[tuple[str, str]] = []
    few: list[tuple[str, str]] = []
    listing: list[tuple[str, str]] = []
    for line in text.split("\n"):
        line = line.strip()
        if not line:
            continue
        size = len(line) if "  " not in line and "\t" not in line else len(re.sub(r"\s+", " ", line))
        total += size
        kind, look = shape(line)
        found = groups[kind, look]
        found[0] += 1
        found[1] += size
        if kind == "sentence":
            prose.append(line)
            continue
        if kind == "data":
            continue
        listing.append((kind, line))
        if kind == "short":
            short.append((line, look))
        elif kind == "link":
            number[kind] += max(1, _unlinked(line)[1])
        elif kind == "tag":
            number[kind] += max(1, len(TAG.findall(line)))
    for kind, least in (("link", FEW), ("tag", FEW // 2)):
        if 0 < number[kind] < least and number[kind] <= 2 * sum(1 + len(INNER.findall(line)) for line in prose):
            few += [key for key in groups if key[0] == kind]
    for key in few:
        groups["few " + key[0] + "s", key[1]] = groups.pop(key)
    # Short lines without an end mark: headings are few; a list of phrases repeats its words from line to line.
    if len(short) >= FEW:
        heads = Counter(w for s, _ in short for w in set(WORD.findall(s.lower())))
        again = [s for s, _ in short if any(heads[w] >= max(3, len(short) // 12) for w in WORD.findall(s.lower()))]
        if len(again) * 2 > len(short):
            for look in {look for _, look in short}:
                groups["listing", look] = groups.pop(("short", look))
    return total, prose, groups, listing


def dominance(total: int, groups: Groups, phrases: int = 0, few: int = FEW_SHAPES) -> float:
    """The share of a page's text that its ``few`` most frequent shapes of stuffing hold; ``phrases`` are the characters of the shape of phrases."""
    return _share(total, _sizes(groups), phrases, few)


def _sizes(groups: Groups) -> list[int]:
    """The characters of each shape of stuffing, the largest first."""
    return sorted((c for (kind, _), (_, c) in groups.items() if kind in STUFFING), reverse=True)


def _share(total: int, sizes: list[int], phrases: int, few: int = FEW_SHAPES) -> float:
    return min(1.0, sum(sorted([*sizes, phrases], reverse=True)[:few]) / max(1, total))


def page(text: str | None, phrases: frozenset[tuple[str, ...]] = frozenset()) -> tuple[float, list[tuple[str, str, int, int]]]:
    """The share of stuffing of a text and its shapes ``(kind, shape, lines, characters)``; 0 and none for blank text."""
    if not text or not text.strip():
        return 0.0, []
    total, prose, groups, _ = _lines(text)
    in_slots = _Prose(prose).chars(phrases)
    found = [(k, s, n, c) for (k, s), (n, c) in groups.items()]
    if in_slots:
        # The text in slots leaves the shapes of sentences, the largest first.
        left, out = in_slots, []
        for k, s, n, c in sorted(found, key=lambda g: (g[0] != "sentence", -g[3])):
            take = min(left, c) if k == "sentence" else 0
            left -= take
            if c > take:
                out.append((k, s, n, c - take))
        found = [*out, ("phrase", "slots", 0, in_slots)]
    return dominance(total, groups, in_slots), found


class _Prose:
    """The words of prose lines, and the characters of those that belong to phrases."""

    def __init__(self, lines: list[str]):
        # A sentence that is repeated as a whole is one sentence: warnings may come again.
        self.run_on = 0
        self.sentences: list[tuple[str, int]] = []
        for s, times in Counter(map(str.strip, SENTENCE.findall("\n".join(lines).replace(PAUSE, " ")))).items():
            if not s:
                continue
            if len(s) >= 50 and s[-1] not in MARKS and not MARKED.search(s):
                ws = WORD.findall(s.lower())
                if len(ws) >= 25 and 3 <= len(set(ws)) <= 0.35 * len(ws):
                    self.run_on += (len(s) + 1) * times  # words without end, the same ones again and again
                    continue
            self.sentences.append((s, times))
        #: All words, with a pause between sentences.
        self.words: list[str] = SPOKEN.findall(PAUSE.join([s for s, _ in self.sentences]).lower())
        self.pairs: Counter[tuple[str, str]] = Counter(zip(self.words, self.words[1:], strict=False))
        self.loose = _loose(self.words, {p for p, n in self.pairs.items() if n >= 3})

    def candidates(self, known: _Filter) -> set[tuple[str, ...]]:
        """The phrases of two to four words that a filter lets through."""
        leads = known.leads(self.pairs.keys())
        if not leads:
            return set()
        found, ws = set(), self.words
        for k, p in enumerate(zip(ws, ws[1:], strict=False)):
            if p in leads:
                found.update(g for n in (2, 3, 4) if len(g := tuple(ws[k : k + n])) == n and PAUSE not in g and known.has(g))
        return found

    def chars(self, phrases: Iterable[tuple[str, ...]]) -> int:
        """Characters of the words that belong to phrases which come back on the page or to the given ones."""
        common = self.loose | {g for g in phrases if g[:2] in self.pairs}
        if not common:
            return self.run_on
        covered = 0
        leads = {g[:2] for g in common}
        at = 0
        for s, times in self.sentences:
            try:
                end = self.words.index(PAUSE, at)
            except ValueError:
                end = len(self.words)
            ws = self.words[at:end]
            at = end + 1
            if leads.isdisjoint(zip(ws, ws[1:], strict=False)):
                continue
            found = [m.span() for m in WORD.finditer(s.lower())]
            inside = [False] * len(ws)
            for n in (2, 3, 4):
                for k in range(len(ws) - n + 1):
                    if tuple(ws[k : k + n]) in common:
                        inside[k : k + n] = [True] * n
            k, size = 0, 0
            while k < len(ws):
                if inside[k]:
                    last = k
                    while last + 1 < len(ws) and inside[last + 1]:
                        last += 1
                    size += found[last][1] - found[k][0] + 1
                    k = last
                k += 1
            # A sentence with hardly any word besides phrases is stuffing as a whole.
            if sum(inside) >= 0.4 * len(ws) and len(ws) >= 3:
                size = len(s) + 1
            covered += min(size, len(s) + 1) * times
        return covered + self.run_on


class _Filter:
    """A Bloom filter of phrases, of their first two words and of the first, of a fixed size: what it keeps out is no phrase, what it lets through is joined."""

    BITS = 1 << 24

    def __init__(self, bits: bytes | bytearray):
        self.bits = bits
        self.yes: set[tuple[str, ...]] = set()
        self.no: set[tuple[str, ...]] = set()
        self.first: set[str] = set()
        self.later: set[str] = set()

    @staticmethod
    def places(key: str) -> tuple[int, int]:
        h = xxhash.xxh3_64_intdigest(key)
        return h % _Filter.BITS, (h >> 32) % _Filter.BITS

    def _test(self, key: str) -> bool:
        return all(self.bits[k >> 3] >> (k & 7) & 1 for k in self.places(key))

    def leads(self, pairs: Set[tuple[str, str]]) -> set[tuple[str, str]]:
        """The pairs of words that a phrase may begin with; words that begin none are told first."""
        if len(self.yes) + len(self.no) + len(self.first) + len(self.later) >= 500_000:
            for known in (self.yes, self.no, self.first, self.later):
                known.clear()
        for word in {p[0] for p in pairs} - self.first - self.later:
            (self.first if word not in GRAMMAR and self._test(">" + word) else self.later).add(word)
        near = {p for p in pairs if p[0] in self.first}
        for pair in near - self.no - self.yes:
            (self.yes if self._test("^" + " ".join(pair)) else self.no).add(pair)
        return near & self.yes

    def has(self, words: tuple[str, ...]) -> bool:
        return self._test(" ".join(words))

    @classmethod
    def of(cls, known: DataFrame) -> bytes:
        """The filter of a table of phrases, made by the executors and put together part by part."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits = bytearray(cls.BITS // 8)
            for batch in batches:
                for phrase in batch.column(0).to_pylist():
                    for key in (phrase, "^" + " ".join(phrase.split(" ")[:2]), ">" + phrase.split(" ")[0]):
                        for k in cls.places(key):
                            bits[k >> 3] |= 1 << (k & 7)
            yield pa.RecordBatch.from_arrays([pa.array([bytes(bits)], pa.binary())], ["bits"])

        whole = np.zeros(cls.BITS // 8, np.uint8)
        for row in known.select("phrase").coalesce(16).mapInArrow(run, "bits binary").toLocalIterator():
            whole |= np.frombuffer(bytes(row.bits), np.uint8)
        return whole.tobytes()


def _loose(words: list[str], often: set[tuple[str, str]]) -> set[tuple[str, ...]]:
    """Phrases of two to four words that stand between ever other neighbours.

    The repeated words of a sentence pattern have the same neighbour on one side; a search phrase stands anywhere. Numbers and codes
    are one neighbour, and so is the border of a sentence. ``often`` has the pairs of words that stand at least three times: a phrase comes back as often only if
    all its pairs do, so that only runs of such pairs are counted.
    """
    number = lambda w: not w.isalpha() and w != "h2" and any(map(str.isdigit, w))
    apart = {w for w in {w for p in often for w in p} if w == PAUSE or number(w)}
    inner = {p for p in often if p[0] not in apart and p[1] not in apart}
    starts = {p for p in inner if p[0] not in GRAMMAR}
    if not starts:
        return set()
    seen: Counter[tuple[str, ...]] = Counter()
    left: dict[tuple[str, ...], set[str]] = defaultdict(set)
    right: dict[tuple[str, ...], set[str]] = defaultdict(set)
    pairs = list(zip(words, words[1:], strict=False))
    words = [PAUSE, *words, PAUSE]
    for k in [k for k, p in enumerate(pairs) if p in starts]:
        before = words[k]
        before = "0" if number(before) else before
        for n in (2, 3, 4):
            end = k + n
            if end - 2 >= len(pairs) or pairs[end - 2] not in inner:
                break
            if words[end] in GRAMMAR:
                continue
            gram = tuple(words[k + 1 : end + 1])
            seen[gram] += 1
            left[gram].add(before)
            after = words[end + 1]
            right[gram].add("0" if number(after) else after)
    return {g for g, n in seen.items() if n >= 3 and min(len(left[g]), len(right[g])) >= max(3, min(6, 0.4 * n))}


def shapes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, shapes array<struct<kind, shape, lines, chars>>)`` of every row.

    Null and blank texts have no shapes; repeated rows come out as often as they stand in the
    table. All lines of a text are in one row, so nothing is shuffled and no text weighs on the others.
    """
    src = docs.select(id_col, text_col)
    item = pa.list_(pa.struct([("kind", pa.string()), ("shape", pa.string()), ("lines", pa.int32()), ("chars", pa.int64())]))
    kind = T.StructType([src.schema[id_col], *T.StructType.fromDDL("shapes array<struct<kind:string,shape:string,lines:int,chars:bigint>>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages = [_lines(t)[2] if t and t.strip() else {} for t in batch.column(1).to_pylist()]
            groups = [[{"kind": k, "shape": s, "lines": n, "chars": c} for (k, s), (n, c) in g.items()] for g in pages]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(groups, item)], [id_col, "shapes"])

    return src.mapInArrow(run, kind)


def _bounds(total: int, sizes: list[int], prose: str, known: _Filter, least: float | None) -> tuple[float, set[tuple[str, ...]]]:
    """The share of stuffing without phrases of the corpus, and the phrases that decide; none where the share, or its side of ``least``, is sure."""
    share = lambda chars: _share(total, sizes, chars)
    # Phrases hold no more than all sentences.
    if not prose or least is not None and (share(0) > least or share(len(prose) + 1 + sum(map(prose.count, MARKS + "…\n"))) <= least):
        return share(0), set()
    words = _Prose(prose.split("\n"))
    low = share(words.chars(()))
    if least is not None and low > least:
        return low, set()
    open_ = words.candidates(known)
    high = share(words.chars(open_)) if open_ else low
    return low, open_ if high > (low if least is None else least) else set()


def page_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, total, sizes, prose, phrases)`` of every row: its characters, those of its shapes of stuffing, its lines of sentences and the phrases it lists."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    names = ["id", "total", "sizes", "prose", "phrases"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                found = [(t, _sizes(g), "\n".join(p), sorted(_phrases(ls))) for t, p, g, ls in map(_lines, part.column(1).fill_null("").to_pylist())]
                kinds = (pa.int64(), pa.list_(pa.int64()), pa.string(), pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds))], names)

    return src.mapInArrow(run, T.StructType([src.schema["id"], *T.StructType.fromDDL("total bigint, sizes array<bigint>, prose string, phrases array<string>").fields]))


def listed_phrases(lines: DataFrame, least_pages: int = 3) -> DataFrame:
    """``(phrase, pages)``: phrases, as words between spaces, that at least ``least_pages`` pages of ``page_lines`` list."""
    return lines.select(F.explode("phrases").alias("phrase")).groupBy("phrase").agg(F.count(F.lit(1)).alias("pages")).filter(F.col("pages") >= least_pages)


def shares(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float | None = None) -> DataFrame:
    """``(id_col, stuffed double)`` of every row; with ``least``, ``stuffed`` is exact only as to whether it is above it.

    The lines of a page are looked at once. The phrases of the corpus stay a distributed table. Most pages are settled without it: a filter of fixed
    size tells which of their phrases it may hold. Only pages that these can decide are joined with the table, by phrase, and counted with those it holds. Null and
    blank texts have share 0; repeated rows come out as often as they stand in the table.
    """
    lines = materialise(page_lines(docs, id_col, text_col), "stuffing-lines")
    known = materialise(listed_phrases(lines), "stuffing-phrases")
    bits = _Filter.of(known)
    of_id = lines.schema["id"]

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = _Filter(bits)
        for batch in batches:
            prose = batch.column(3).to_pylist()
            found = [_bounds(t, s, p, near, least) for t, s, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), prose, strict=True)]
            key = [hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest() if c else None for t, (_, c) in zip(prose, found, strict=True)]
            columns = [pa.array([s for s, _ in found], pa.float64()), pa.array(key, pa.string()), pa.array([t if k else None for t, k in zip(prose, key, strict=True)], pa.string()), pa.array([sorted(map(" ".join, c)) if c else None for _, c in found], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], names)

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_share(t, s, _Prose(p.split("\n")).chars(frozenset(tuple(h.split(" ")) for h in hs or ()))) for t, s, p, hs in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], ["id", "stuffed"])

    fields = T.StructType.fromDDL("total bigint, sizes array<bigint>, stuffed double, key string, prose string, phrases array<string>").fields
    names = ["id", *(f.name for f in fields)]
    each = materialise(lines.select("id", "total", "sizes", "prose").mapInArrow(first, T.StructType([of_id, *fields])), "stuffing-pages")
    undecided = each.filter("key is not null")
    # Equal texts have equal phrases: they are joined once.
    held = undecided.select("key", F.explode("phrases").alias("phrase")).distinct().join(known.select("phrase"), "phrase").groupBy("key").agg(F.collect_list("phrase").alias("held"))
    decided = undecided.join(held, "key", "left").select("id", "total", "sizes", "prose", "held").mapInArrow(second, T.StructType([of_id, fields[2]]))
    return each.filter("key is null").select("id", "stuffed").unionByName(decided).withColumnRenamed("id", id_col)


def stuffed_pages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The ids of the pages of whose text more than ``least`` is stuffing; a page of several rows comes out for each."""
    return shares(docs, id_col, text_col, least).filter(F.col("stuffed") > least).select(id_col)


def shape_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(kind, shape, pages, lines, chars)``: the shapes of a corpus, with the pages they stand on."""
    each = shapes(docs, id_col, text_col).select(F.explode("shapes").alias("s")).select("s.*")
    return each.groupBy("kind", "shape").agg(F.count(F.lit(1)).alias("pages"), F.sum("lines").alias("lines"), F.sum("chars").alias("chars"))
