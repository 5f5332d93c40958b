"""Substring dedup by repeated-phrase automata.

A window is `span` words in a row of one document.  Words covered by a window that also starts in a document with a smaller
id are removed; windows are judged on the input.

The documents are dealt once into groups of a few megabytes, which three rounds read.
1. Of each window the k-gram of words with the least hash (rightmost of equals) is its anchor; equal windows have equal
   anchors.  Groups send their distinct anchors to the buckets these fall into, and hear which recur in other documents.
2. Groups send the phrases around recurring anchors, each distinct phrase once with its first document, to the bucket of the
   anchor.  (A phrase is the words of all windows of one anchor; where an anchor recurs in many groups, each window is
   a phrase of its own and goes to a bucket by its own hash, so that no bucket gets all that surrounds a common line.)
   A bucket is a shard: it confirms what recurs (phrases that several documents hold, and windows that stand in several
   different phrases, by hash), compiles it into an Aho-Corasick automaton, each with its first document, and streams all its
   phrases through it.  In the automaton a word is a letter, so a window is a key of `span` letters.  Shards of too many windows are
   cut by anchor into several automata, one at a time.
3. Groups hear where windows were found, and cover their words.

Groups answer for their own documents, so a passage that stands in a third of all documents is sent once a group.

Cases: null and wordless texts have no words; texts of fewer words than a window lose none; repeated rows and rows of equal
id are not each other's copies, unless the words also stand in a smaller id; rows without id come after all others and keep
what only such rows hold; very long texts are handled whole, in a group of their own size; extra columns stay, whatever they
are called (the two names that start with `__passages_` are an error).
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, compress, count

import ahocorasick
import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import BLOCK_BYTES, byte_class, grams, mix, released, window_minima, within, words
from .shared import spare

SPAN = 13
GRAM = 5
#: Bytes of text in a group, on average.
GROUP_BYTES = 3 << 20
#: Bytes of text that a task deals with at most, about; buckets are a quarter of that.
PARTITION_BYTES = 64 << 20
#: Windows in one automaton, about.
AUTOMATON_WINDOWS = 150_000
#: Anchors of more groups than this have their windows sent one by one.
COMMON_GROUPS = 48
#: Words that fit into the letters of a text: the characters without surrogates.
LETTERS = 0x10FFFF - 0x800

_TABLE = byte_class(lower=False, alnum=False)
_NONE = np.iinfo(np.int64).max
_G, _B = "__passages_group", "__passages_bucket"


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(where the words of each text begin, hashes of the words, their bytes): told a block at a time, which needs many times its own bytes."""
    first, hashed, size, row, n = [np.zeros(1, np.int64)], [np.empty(0, np.uint64)], [np.empty(0, np.int64)], 0, 0
    while row < len(offsets) - 1:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + BLOCK_BYTES, "right")) - 1)
        w = words(data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row], _TABLE)
        first.append(w.first[1:] + n)
        hashed.append(w.hash)
        size.append(w.end - w.start)
        row, n = stop, n + len(w)
    return np.concatenate(first), np.concatenate(hashed), np.concatenate(size)


class _Group:
    """The documents of a group in a fixed order, with their words, windows and anchors."""

    def __init__(self, table: pa.Table, span: int, k: int):
        ids = table.column("doc_id").combine_chunks()
        number = np.array(ids.fill_null(_NONE), np.int64) if len(ids) else np.empty(0, np.int64)
        texts = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in table.column("text").combine_chunks().cast(pa.binary())]
        order = sorted(range(len(texts)), key=lambda i: (number[i], texts[i]))
        self.order = order
        self.ids = number[order]
        self.spelled = b"\n".join(texts[i] for i in order)
        sizes = np.array([len(texts[i]) for i in order], np.int64)
        offsets = np.concatenate([[0], np.cumsum(sizes + 1)])
        data = np.frombuffer(self.spelled + b"\n", np.uint8) if order else np.empty(0, np.uint8)
        self.first, self.hash, self.size = _words(data, offsets)
        self.start = np.flatnonzero(within(self.first, span, len(self.hash)))
        g = grams(self.hash, k)
        self.at = window_minima(g, span - k + 1)[self.start] if len(self.start) else self.start
        self.anchor = g[self.at] if len(self.start) else np.empty(0, np.uint64)
        self.doc = np.searchsorted(self.first, self.start, "right") - 1


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(hashes) % np.uint64(buckets)).astype(np.int64)


def _runs(values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    at = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else []
    for a, z in zip(at, [*at[1:], len(values)]):
        yield int(values[a]), int(a), int(z)


def _bytes_column(column: pa.ChunkedArray, kind) -> list[np.ndarray]:
    return [np.frombuffer(b.as_buffer(), kind) for b in column]


def _anchors(table: pa.Table, span: int, k: int, buckets: int) -> pa.Table:
    """Round 1, asked: distinct anchors, and whether they stand in more than one document here."""
    g = table.column(_G)[0].as_py()
    group = _Group(table, span, k)
    ids = group.ids[group.doc] if len(group.start) else np.empty(0, np.int64)
    order = np.lexsort((ids, group.anchor))
    anchor, ids = group.anchor[order], ids[order]
    new = np.concatenate([[True], anchor[1:] != anchor[:-1]])[: len(anchor)]
    at = np.flatnonzero(new)
    distinct = anchor[at]
    many = ids[at] != ids[np.append(at[1:], len(ids)) - 1] if len(at) else np.empty(0, bool)
    bucket = _bucket(distinct, buckets)
    order = np.argsort(bucket, kind="stable")
    rows = [(b, g, distinct[order[a:z]].tobytes(), many[order[a:z]].tobytes()) for b, a, z in _runs(bucket[order])]
    columns = list(zip(*rows)) or [[]] * 4
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=[_B, _G, "anchors", "many"])


def _recurring(table: pa.Table, common: int) -> pa.Table:
    """Round 1, answered: to each group, which of its anchors recur, and whether in very many groups."""
    group = np.array(table.column(_G), np.int64)
    anchors = _bytes_column(table.column("anchors"), np.uint64)
    many = np.concatenate(_bytes_column(table.column("many"), bool))
    of = np.repeat(np.arange(len(anchors)), [len(a) for a in anchors])
    anchor = np.concatenate(anchors)
    distinct, back, n = np.unique(anchor, return_inverse=True, return_counts=True)
    found = np.zeros(len(distinct), bool)
    found[back[many]] = True
    found |= n > 1
    keep = found[back]
    anchor, of, wide = anchor[keep], of[keep], (n[back] > common)[keep]
    rows = [(int(group[i]), anchor[a:z].tobytes(), wide[a:z].tobytes()) for i, a, z in _runs(of)]
    columns = list(zip(*rows)) or [[]] * 3
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.binary()))], names=[_G, "anchors", "wide"])


def _phrases(table: pa.Table, answer: pa.Table, span: int, k: int, buckets: int) -> pa.Table:
    """Round 2, asked: the distinct phrases around recurring anchors, and where they stand."""
    names = (_B, _G, "key", "phrases", "windows", "first", "many", "times", "docs", "starts")
    kinds = (pa.int32(), pa.int64(), *[pa.binary()] * 8)
    if not table.num_rows or not answer.num_rows:
        return pa.table([pa.array([], t) for t in kinds], names=list(names))
    g = table.column(_G)[0].as_py()
    group = _Group(table, span, k)
    anchors = np.concatenate(_bytes_column(answer.column("anchors"), np.uint64))
    wide = np.concatenate(_bytes_column(answer.column("wide"), bool))
    order = np.argsort(anchors)
    anchors, wide = anchors[order], wide[order]
    place = np.searchsorted(anchors, group.anchor)
    place[place == len(anchors)] = 0
    mine = np.flatnonzero(anchors[place] == group.anchor)
    start, at, doc, key, single = group.start[mine], group.at[mine], group.doc[mine], group.anchor[mine].copy(), wide[place[mine]]
    new = np.ones(len(start), bool)
    new[1:] = single[1:] | (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1) | (doc[1:] != doc[:-1])
    lone = np.flatnonzero(single)
    if len(lone):
        key[lone] = grams(group.hash[start[lone][:, None] + np.arange(span)].T.copy(), span)[0]
    begin = np.flatnonzero(new)
    n = np.diff(np.append(begin, len(start)))
    # a phrase is told by its first and last window, which overlap, and its length
    ends = start[begin] + n - 1
    edges = grams(group.hash[np.concatenate([start[begin], ends])[:, None] + np.arange(span)].T.copy(), span)[0]
    told = mix(edges[: len(n)] ^ mix(edges[len(n) :] + n.astype(np.uint64)))
    key, doc, begin = key[begin], doc[begin], start[begin]
    order = np.lexsort((group.ids[doc], told, _bucket(key, buckets)))
    told, key, doc, begin, n = told[order], key[order], doc[order], begin[order], n[order]
    at = np.flatnonzero(np.concatenate([[True], (told[1:] != told[:-1]) | (key[1:] != key[:-1])])[: len(told)])
    times = np.diff(np.append(at, len(told)))
    least, most = group.ids[doc[at]], group.ids[doc[at + times - 1]]
    line = b" ".join(group.spelled.split())
    edge = np.concatenate([[0], np.cumsum(group.size + 1)])
    left, right = edge[begin[at]].tolist(), (edge[begin[at] + n[at] + span - 1] - 1).tolist()
    place = (begin - group.first[doc]).astype(np.uint32)
    pack = zstandard.ZstdCompressor(level=3).compress
    rows = []
    for b, i, j in _runs(_bucket(key[at], buckets)):
        each = slice(at[i], at[j - 1] + times[j - 1])
        text = pack(b"\n".join([line[x:y] for x, y in zip(left[i:j], right[i:j])]))
        rows.append((b, g, key[at[i:j]].tobytes(), text, n[at[i:j]].astype(np.uint32).tobytes(), least[i:j].tobytes(), (least[i:j] != most[i:j]).tobytes(), times[i:j].astype(np.uint32).tobytes(), doc[each].astype(np.uint32).tobytes(), place[each].tobytes()))
    columns = list(zip(*rows)) or [[]] * 10
    return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], names=list(names))


def _numbered(phrases: list[bytes]) -> tuple[np.ndarray, np.ndarray, int]:
    """(numbers of the words, one phrase after the other; where each phrase begins; how many distinct words there are)."""
    number: defaultdict[bytes, int] = defaultdict(count(1).__next__)
    lines = [list(map(number.__getitem__, p.split(b" "))) for p in phrases]
    first = np.concatenate([[0], np.cumsum(np.fromiter(map(len, lines), np.int64, len(lines)))])
    return np.fromiter(chain.from_iterable(lines), np.uint64, int(first[-1])), first, len(number)


def recurring(flat: np.ndarray, first: np.ndarray, least: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, first document) of each window that stands in several of these different phrases, once: told by two 64-bit hashes."""
    place = np.flatnonzero(within(first, span, len(flat)))
    if not len(place):
        return place, place
    phrase = np.searchsorted(first, place, "right") - 1
    one, two = (grams(mix(flat + np.uint64(salt)), span)[place] for salt in (0, 1 << 40))
    order = np.lexsort((two, one))
    one, two, phrase = one[order], two[order], phrase[order]
    at = np.flatnonzero(np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])]))
    several = np.minimum.reduceat(phrase, at) != np.maximum.reduceat(phrase, at)
    return place[order[at[several]]], np.minimum.reduceat(least[phrase], at)[several]


def locate(phrases: list[bytes], first: list[int], many: list[bool], span: int) -> list[list[int]]:
    """For each of these different phrases, and each window in it, the first document that a confirmed window starts in, else _NONE.

    first: the least document that holds the phrase; many: whether several hold it.  What recurs (phrases that several
    documents hold, and windows of several phrases) is compiled into an automaton; all phrases are streamed through it.
    Words are its letters: characters, or whole numbers where there are more words than characters.
    """
    flat, at, n = _numbered(phrases)
    where, holder = recurring(flat, at, np.array(first, np.int64), span)
    if n <= LETTERS:  # surrogates are no characters
        text = (flat + np.where(flat < 0xD800, np.uint64(0), np.uint64(0x800))).astype("<u4").tobytes().decode("utf-32-le")
        automaton = ahocorasick.Automaton()
    else:
        text = tuple(flat.tolist())
        automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    lines = [text[a:z] for a, z in zip(at.tolist(), at[1:].tolist())]
    for line, doc, several in zip(lines, first, many):
        if several:
            automaton.add_word(line, (len(line), doc))
    for i, doc in zip(where.tolist(), holder.tolist()):  # takes the place of a phrase that is this window alone
        automaton.add_word(text[i : i + span], (span, doc))
    out = [[_NONE] * (len(line) - span + 1) for line in lines]
    if len(automaton):
        automaton.make_automaton()
        for line, found in zip(lines, out):
            for end, (length, doc) in automaton.iter(line):
                for i in range(end - length + 1, end - span + 2):
                    if doc < found[i]:
                        found[i] = doc
    return out


def _located(table: pa.Table, span: int) -> pa.Table:
    """Round 2, answered: to each group, where its phrases stand and the first documents of their windows."""
    groups = table.column(_G).to_pylist()
    column = lambda name, kind: _bytes_column(table.column(name), kind)
    keys, windows, first, many = column("key", np.uint64), column("windows", np.uint32), column("first", np.int64), column("many", bool)
    unpack = zstandard.ZstdDecompressor().decompress
    number: dict[bytes, int] = {}
    of = [np.array([number.setdefault(p, len(number)) for p in unpack(b.as_buffer().to_pybytes()).split(b"\n")], np.int64) for b in table.column("phrases")]
    each, n = np.concatenate(of), len(number)
    least, size, key = np.full(n, _NONE, np.int64), np.zeros(n, np.int64), np.zeros(n, np.uint64)
    np.minimum.at(least, each, np.concatenate(first))
    size[each], key[each] = np.concatenate(windows), np.concatenate(keys)
    several = np.bincount(each, minlength=n) > 1
    several[each[np.concatenate(many)]] = True
    spelled = list(number)
    del number
    parts = max(1, int(-(-int(size.sum()) // AUTOMATON_WINDOWS)))
    part = (mix(key ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(parts)).astype(np.int64)
    begin = np.cumsum(size) - size
    owners = np.full(int(size.sum()), _NONE, np.int64)
    order = np.argsort(part, kind="stable")
    for _, a, z in _runs(part[order]):
        chosen = order[a:z]
        found = locate([spelled[i] for i in chosen.tolist()], least[chosen].tolist(), several[chosen].tolist(), span)
        for i, x in zip(begin[chosen].tolist(), found):
            owners[i : i + len(x)] = x
    use = np.minimum.reduceat(owners, begin) != _NONE if n else np.empty(0, bool)
    rows = []
    for i, g in enumerate(groups):
        mine = use[of[i]]
        if mine.any():
            times, docs, starts = (np.frombuffer(table.column(c)[i].as_buffer(), np.uint32) for c in ("times", "docs", "starts"))
            spread, chosen = np.repeat(mine, times), of[i][mine]
            k = size[chosen]
            places = np.repeat(begin[chosen] - (np.cumsum(k) - k), k) + np.arange(k.sum())
            rows.append((g, times[mine].tobytes(), docs[spread].tobytes(), starts[spread].tobytes(), windows[i][mine].tobytes(), owners[places].tobytes()))
    columns = list(zip(*rows)) or [[]] * 6
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), *[pa.binary()] * 5))], names=[_G, "times", "docs", "starts", "windows", "owners"])


def _covered(group: _Group, answer: pa.Table, span: int) -> np.ndarray:
    """Round 3: the words to remove."""
    edge = np.zeros(len(group.hash) + 1, np.int64)
    for row in range(answer.num_rows):
        get = lambda name, kind=np.uint32: np.frombuffer(answer.column(name)[row].as_buffer(), kind).astype(np.int64)  # noqa: E731, B023
        times, docs, starts, windows, owners = get("times"), get("docs"), get("starts"), get("windows"), get("owners", np.int64)
        base = np.cumsum(windows) - windows
        n, base = np.repeat(windows, times), np.repeat(base, times)
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        doc = np.repeat(docs, n)
        hit = owners[np.repeat(base, n) + step] < group.ids[doc]
        place = (group.first[doc] + np.repeat(starts, n) + step)[hit]
        np.add.at(edge, place, 1)
        np.add.at(edge, place + span, -1)
    return np.cumsum(edge[:-1]) > 0


def remove_repeated(docs: DataFrame, *, span: int = SPAN, k: int = GRAM, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """docs with n_words, n_removed and kept: the text's words that are not removed, joined by one space.

    docs has doc_id (a whole number) and text; columns of these three names are replaced.
    """
    if clash := {c: spare(docs.columns, c) for c in docs.columns if c in (_G, _B)}:
        out = remove_repeated(docs.withColumnsRenamed(clash), span=span, k=k, group_bytes=group_bytes)
        return out.withColumnsRenamed({new: c for c, new in clash.items()})
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PARTITION_BYTES))
    groups = max(1, -(-total // group_bytes))
    buckets = 4 * n
    common = COMMON_GROUPS
    columns = [c for c in docs.columns if c not in ("n_words", "n_removed", "kept")]
    dealt = docs.select(*[F.col(f"`{c}`") for c in columns], F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)).alias(_G)).repartition(n, _G)
    anchors = dealt.groupBy(_G).applyInArrow(lambda t: released(_anchors(t, span, k, buckets)), f"{_B} int, {_G} bigint, anchors binary, many binary")
    recurring = anchors.groupBy(_B).applyInArrow(lambda t: released(_recurring(t, common)), f"{_G} bigint, anchors binary, wide binary")
    phrases = dealt.groupBy(_G).cogroup(recurring.groupBy(_G)).applyInArrow(lambda t, a: released(_phrases(t, a, span, k, buckets)), f"{_B} int, {_G} bigint, key binary, phrases binary, windows binary, first binary, many binary, times binary, docs binary, starts binary")
    located = phrases.groupBy(_B).applyInArrow(lambda t: released(_located(t, span)), f"{_G} bigint, times binary, docs binary, starts binary, windows binary, owners binary")
    schema = T.StructType([docs.schema[c] for c in columns] + [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])

    def finish(table: pa.Table, answer: pa.Table) -> pa.Table:
        group = _Group(table, span, k)
        gone = _covered(group, answer, span)
        spelled = group.spelled.split()
        stays = (~gone).tolist()
        kept = [b" ".join(compress(spelled[a:z], stays[a:z])).decode() for a, z in zip(group.first[:-1].tolist(), group.first[1:].tolist())]
        out = np.concatenate([[0], np.cumsum(gone)])
        rows = table.select(columns).take(pa.array(group.order, pa.int64()))
        return pa.table([*rows.columns, pa.array(np.diff(group.first)), pa.array(out[group.first[1:]] - out[group.first[:-1]]), pa.array(kept, pa.string())], names=schema.names)

    return dealt.groupBy(_G).cogroup(located.groupBy(_G)).applyInArrow(lambda t, a: released(finish(t, a)), schema)
