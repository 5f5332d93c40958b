"""Byte-level BPE by a prefix-sharing trie traversal: encoding, decoding and token counts.

A tokenizers JSON file of the byte-level kind (its path is a parameter) gives vocabulary, merges and special tokens.
Text is cut at special tokens, then into pre-tokens, as the tokenizers library does.

Encoding rests on a property of BPE: the encoding of a word's prefix of i bytes ends in the only token t that is a suffix
of it, and that stays apart from the last token of the encoding of the i - len(t) bytes before it.  So each prefix needs
only its last token.  The distinct pre-tokens of a block go into a trie (sorted words are its depth-first order, the stack
holds the path), last tokens are passed down, and what words share at their front is computed once.  Each distinct
pre-token is then read off its chain of last tokens.

Counting makes no ids.  Tasks pack their documents' frequencies of pre-tokens by buckets of pre-tokens; a bucket has all of its
pre-tokens from all documents, measures each distinct one once in one trie, joins the counts to the frequencies, and sends
back what they add up to in each document, where the buckets' sums are added.

Cases: null texts count as empty; an empty text has no ids; long texts are handled whole; repeated rows give repeated rows;
extra columns stay, and those called like a new one are replaced.
"""

from __future__ import annotations

import json
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import accumulate, chain
from itertools import count as numbers_from

import numpy as np
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import Block, cut, release

#: Distinct pre-tokens, and pairs of tokens, that a worker remembers from block to block.
REMEMBERED = 150_000
REMEMBERED_PAIRS = 1_000_000
#: Bytes of text whose distinct pre-tokens share a trie.
BLOCK = 4 << 20
#: Bytes of text whose frequencies of pre-tokens a task packs at a time, and bytes of text for a bucket of pre-tokens, about.
PACK_BYTES, BUCKET_BYTES = 16 << 20, 32 << 20


_NEVER = (1 << 60, -1)


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in files of byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _spell(letters: dict[str, int], token: str) -> bytes:
    return bytes(letters[c] for c in token)


#: The usual pattern of byte-level BPE, for texts whose characters `re` classes as the library does.
_QUICK = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


class Spelling:
    """The bytes of each token: all that decoding needs."""

    def __init__(self, by_id: dict[int, bytes]):
        every = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
        self.length = np.array([len(b) for b in every])
        self.place = np.cumsum(self.length) - self.length
        self.spelled = np.frombuffer(b"".join(every), np.uint8)

    @classmethod
    def read(cls, path: str) -> Spelling:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        return cls({i: _spell(letters, s) for s, i in spec["model"]["vocab"].items()} | {x["id"]: x["content"].encode() for x in spec["added_tokens"]})

    def decode(self, rows: pa.ListArray) -> pa.Array:
        """Texts of lists of ids: the tokens' bytes, gathered by place."""
        rows = rows.fill_null([]) if rows.null_count else rows
        at = np.asarray(rows.offsets, np.int64)
        ids = np.asarray(rows.values, np.int64)[at[0] : at[-1]]
        n = self.length[ids]
        ends = np.concatenate([[0], np.cumsum(n)])
        data = self.spelled[np.repeat(self.place[ids] - ends[:-1], n) + np.arange(ends[-1])]
        offsets = ends[at - at[0]]
        try:
            out = pa.Array.from_buffers(pa.large_string(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
            out.validate(full=True)
        except pa.ArrowInvalid:  # some bytes are no UTF-8
            raw = data.tobytes()
            out = pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets.tolist(), offsets[1:].tolist())], pa.large_string())
        return out.cast(pa.string())


class ByteBPE:
    """One tokenizer file.  whole: bits that tell which tokens BPE makes of their own bytes, as whole_tokens() has them; without, they are found out here."""

    def __init__(self, path: str, whole: bytes | None = None):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec["pre_tokenizer"] or {}, spec["model"]
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex") or spec["normalizer"] or spec["post_processor"] or model.get("ignore_merges") or model.get("dropout"):
            raise ValueError(f"{path}: only plain byte-level BPE without normaliser, prefix space and post-processor is supported")
        if any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in spec["added_tokens"]):
            raise ValueError(f"{path}: special tokens that take in their surroundings are not supported")
        letters = _byte_letters()
        spell = lambda s: _spell(letters, s)
        self.ids = {spell(s): i for s, i in model["vocab"].items()}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.bytes = {i: b for b, i in self.ids.items()} | {i: s.encode() for s, i in self.special.items()}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.rank = {(self.ids[spell(a)], self.ids[spell(b)]): (r, self.ids[spell(a + b)]) for r, (a, b) in enumerate(pairs)}
        self.made_of = {made: (r, a, b) for (a, b), (r, made) in self.rank.items()}
        self.longest = max(map(len, self.ids))
        if whole is None:
            self.whole = {b: i for b, i in self.ids.items() if self.merge(b) == [i]}
        else:
            bits = np.unpackbits(np.frombuffer(whole, np.uint8))
            self.whole = {b: i for b, i in self.ids.items() if bits[i]}
        self.apart: list[dict[int, bool]] = [{} for _ in range(max(self.bytes) + 1)]
        self._pairs = 0
        self._edges: tuple[dict, dict] = ({}, {})
        self.spelling = Spelling(self.bytes)
        self.known: dict[str, tuple[int, ...]] = {}
        self._known: dict[str, tuple[int, ...]] = {}
        self._split = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self._library = Tokenizer.from_file(path).pre_tokenizer
        self._seen = {chr(c) for c in range(128)}
        self._odd: dict[str, set[str]] = {"L": set(), "N": set(), "S": set(), "P": set()}
        self._slow: set[str] = set()
        self._compile()

    def whole_tokens(self) -> bytes:
        bits = np.zeros(max(self.bytes) + 1, np.uint8)
        bits[list(self.whole.values())] = 1
        return np.packbits(bits).tobytes()

    # -- pre-tokens

    def _compile(self) -> None:
        """The usual pattern of byte-level BPE; characters that the library classes otherwise than `regex` are listed."""
        odd = {k: "".join(map(regex.escape, sorted(v))) for k, v in self._odd.items()}
        every = set().union(*self._odd.values())
        not_odd = f"(?![{''.join(map(regex.escape, sorted(every)))}])" if every else ""

        def kind(base: str, name: str) -> str:
            return f"(?:{not_odd}{base}|[{odd[name]}])" if odd[name] else f"(?:{not_odd}{base})" if every else base

        letter, number, space = kind(r"\p{L}", "L"), kind(r"\p{N}", "N"), kind(r"\s", "S")
        other = kind(r"[^\s\p{L}\p{N}]", "P")
        solid = rf"(?:{letter}|{number}|{other})" if every else r"\S"
        self._pieces = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?{letter}+| ?{number}+| ?{other}+|{space}+(?!{solid})|{space}+")

    def _classes(self, text: str) -> re.Pattern:
        """The pattern for a text.  Compares the classes of characters not seen before with the library's own; where all are as `re` has them, its faster pattern will do."""
        letters = set(text)
        new = letters - self._seen
        if not new:
            return self._pieces if self._slow and not letters.isdisjoint(self._slow) else _QUICK
        changed = False
        for c in new:
            mine = "L" if regex.match(r"\p{L}", c) else "N" if regex.match(r"\p{N}", c) else "S" if regex.match(r"\s", c) else "P"
            one = lambda before: len(self._library.pre_tokenize_str(before + c)) == 1  # noqa: E731, B023
            theirs = "L" if one("a") else "N" if one("1") else "P" if one("!") else "S"
            if mine != theirs:
                self._odd[theirs].add(c)
                changed = True
            if theirs != ("L" if re.match(r"[^\W\d_]", c) else "N" if re.match(r"\d", c) else "S" if re.match(r"\s", c) else "P"):
                self._slow.add(c)
        self._seen |= new
        if changed:
            self._compile()
        return self._classes(text)

    def parts(self, text: str) -> Iterator[tuple[list[str], int | None]]:
        """Pre-tokens of each stretch, and the id of the special token after it, if any."""
        pieces = self._classes(text).findall
        if self._split is None:
            yield pieces(text), None
            return
        at = 0
        for m in self._split.finditer(text):
            yield pieces(text[at : m.start()]), self.special[m[0]]
            at = m.end()
        yield pieces(text[at:] if at else text), None

    # -- the trie

    def merge(self, word: bytes) -> list[int]:
        """BPE as defined, merge by merge; for short strings."""
        ids = [self.ids[word[i : i + 1]] for i in range(len(word))]
        while len(ids) > 1:
            best = min(((self.rank.get(p, (1 << 60, 0)), i) for i, p in enumerate(zip(ids, ids[1:]))), key=lambda x: (x[0][0], x[1]))
            if best[0][0] == 1 << 60:
                break
            i = best[1]
            ids[i : i + 2] = [best[0][1]]
        return ids

    def stays_apart(self, a: int, b: int) -> bool:
        """Whether BPE leaves two tokens side by side as they are."""
        if self._pairs >= REMEMBERED_PAIRS:
            self._pairs = 0
            for known in self.apart:
                known.clear()
        self._pairs += 1
        ok = self.apart[a][b] = not any(born_x < r and born_y < r < gone_x and r <= gone_y for x, born_x, gone_x in self.edge(a, 1) for y, born_y, gone_y in self.edge(b, 0) if (r := self.rank.get((x, y), _NEVER)[0]) != _NEVER[0])
        return ok

    def edge(self, token: int, side: int) -> list[tuple[int, int, int]]:
        """The tokens that stand at one side (0 left, 1 right) while BPE builds this one: (token, merge that makes it, merge that uses it up), by rank.

        A pair across a border merges if both are there at its rank; of equal ranks the merge further left comes first.
        """
        if (known := self._edges[side].get(token)) is None:
            known, gone, t = [], _NEVER[0], token
            while t in self.made_of:
                born, *halves = self.made_of[t]
                known.append((t, born, gone))
                t, gone = halves[side], born
            known.append((t, -1, gone))
            self._edges[side][token] = known
        return known

    def walk(self, words: list[bytes]) -> Iterator[tuple[bytes, list[int], list[int]]]:
        """Words in depth-first order of their trie, each with the last token of all its prefixes, and where that starts."""
        get, longest, apart, stays_apart = self.whole.get, self.longest, self.apart, self.stays_apart
        last, start, after, before = [-1], [0], [{}], b""
        for word in sorted(words):
            n, same, most = len(word), 0, min(len(word), len(before))
            while same < most and word[same] == before[same]:
                same += 1
            del last[same + 1 :], start[same + 1 :], after[same + 1 :]
            for i in range(same + 1, n + 1):
                for j in range(i - longest if i > longest else 0, i):
                    t = get(word[j:i])
                    if t is not None:
                        if not j:
                            break
                        ok = after[j].get(t)
                        if ok or ok is None and stays_apart(last[j], t):
                            break
                else:
                    raise ValueError("a byte without a token")
                last.append(t)
                start.append(j)
                after.append(apart[t])
            before = word
            yield word, last, start

    @staticmethod
    def _recall(recent: dict, older: dict, pieces: set[str]) -> tuple[dict, dict, set[str]]:
        """The two generations of a bounded memory, and the pre-tokens that neither has."""
        new = pieces - recent.keys()
        if len(recent) + len(new) > REMEMBERED:
            recent, older, new = {}, recent, pieces
        for p in new & older.keys():
            recent[p] = older[p]
        return recent, older, new - recent.keys()

    def learn(self, pieces: set[str]) -> dict[str, tuple[int, ...]]:
        """Ids of the pre-tokens (and of others seen lately)."""
        self.known, self._known, new = self._recall(self.known, self._known, pieces)
        by_bytes = {p.encode(): p for p in new}
        for word, last, start in self.walk(list(by_bytes)):
            ids, i = [], len(word)
            while i:
                ids.append(last[i])
                i = start[i]
            self.known[by_bytes[word]] = tuple(reversed(ids))
        return self.known

    def measure(self, pieces: list[str]) -> np.ndarray:
        """Token counts of these distinct pre-tokens; no ids are made."""
        place = {p.encode(): i for i, p in enumerate(pieces)}
        out = np.zeros(len(pieces), np.int64)
        for word, _, start in self.walk(list(place)):
            n, i = 0, len(word)
            while i:
                n += 1
                i = start[i]
            out[place[word]] = n
        return out

    def forget(self) -> None:
        """Empties the memories: a worker outlives its task, and the next may be another operator's."""
        self.known, self._known, self._edges, self._pairs = {}, {}, ({}, {}), 0
        for known in self.apart:
            known.clear()
        release()

    def numbered(self, texts: list[str]) -> tuple[list[str], list[np.ndarray], np.ndarray]:
        """Distinct pre-tokens, and each text as their numbers; a special token is numbered -1 - id."""
        number: defaultdict[str, int] = defaultdict(numbers_from().__next__)
        rows = []
        for text in texts:
            line: list[int] = []
            for pieces, special in self.parts(text):
                line.extend(map(number.__getitem__, pieces))
                if special is not None:
                    line.append(-1 - special)
            rows.append(np.array(line, np.int32))
        at = np.zeros(len(rows) + 1, np.int64)
        np.cumsum([len(r) for r in rows], out=at[1:])
        return list(number), rows, at

    def encode_all(self, texts: list[str]) -> pa.ListArray:
        """Ids of each text: those of the distinct pre-tokens, gathered by place."""
        pieces, rows, at = self.numbered(texts)
        known = self.learn(set(pieces))
        ids = [known[p] for p in pieces]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.int32, int(size.sum()))
        place = np.cumsum(size) - size
        line = np.concatenate([np.empty(0, np.int32), *rows])
        special = line < 0
        if special.any():  # they follow the others in the table that is read from
            names, where = np.unique(line[special], return_inverse=True)
            place = np.append(place, len(flat) + np.arange(len(names)))
            size = np.append(size, np.ones(len(names), np.int64))
            flat = np.append(flat, -1 - names).astype(np.int32)
            line[special] = len(pieces) + where
        n = size[line]
        ends = np.concatenate([[0], np.cumsum(n)])
        out = flat[np.repeat(place[line] - ends[:-1], n) + np.arange(ends[-1])]
        return pa.ListArray.from_arrays(pa.array(ends[at].astype(np.int32)), pa.array(out))

    def decode_all(self, rows: pa.ListArray) -> pa.Array:
        return self.spelling.decode(rows)

    def frequencies(self, texts: list[str], number: dict[str, int]) -> tuple[list[int], list[int], list[int], list[int]]:
        """(numbers of the distinct pre-tokens of each text, one text after the other; how often each stands there; how many each text has; its special tokens)."""
        piece, times, distinct, special = [], [], [], []
        for text in texts:
            found: Counter[str] = Counter()
            n = 0
            for pieces, token in self.parts(text):
                found.update(pieces)
                n += token is not None
            piece.extend(map(number.__getitem__, found))
            times.extend(found.values())
            distinct.append(len(found))
            special.append(n)
        return piece, times, distinct, special

    def count_all(self, texts: list[str]) -> list[int]:
        """Token counts of texts, in memory."""
        number: defaultdict[str, int] = defaultdict(numbers_from().__next__)
        piece, times, distinct, special = self.frequencies(texts, number)
        n = self.measure(list(number))[np.array(piece, np.int64)] * np.array(times, np.int64)
        ends = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(distinct)]).astype(np.int64)]
        return (np.diff(ends) + special).astype(np.int64).tolist()


_loaded: dict[str, ByteBPE] = {}


def load(path: str, whole: bytes | None = None) -> ByteBPE:
    """The tokenizer at the path, read once in a process."""
    if path not in _loaded:
        _loaded[path] = ByteBPE(path, whole)
    return _loaded[path]


_spellings: dict[str, Spelling] = {}


def spelling(path: str) -> Spelling:
    """The spelling of the tokenizer at the path, read once in a process."""
    if path not in _spellings:
        _spellings[path] = Spelling.read(path)
    return _spellings[path]


def _add(df: DataFrame, text: str, name: str, kind: pa.DataType, spark_type: T.DataType, make, done) -> DataFrame:
    """df with one more column (replacing one of that name), made from blocks of rows by make(block); done() is called at the end of a task."""
    keep = [c for c in df.columns if c != name]
    source = df.select(*[F.col(f"`{c}`") for c in keep])
    schema = T.StructType([*source.schema.fields, T.StructField(name, spark_type)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in cut(batch, text, BLOCK):
                yield pa.RecordBatch.from_arrays([*block.batch.columns, make(block).cast(kind)], names=[*keep, name])
        done()

    return source.mapInArrow(run, schema)


def bpe_encode(df: DataFrame, tokenizer_path: str, *, text: str = "text", ids: str = "ids") -> DataFrame:
    """df with `ids`, an array of the text's token ids.  A column of that name is replaced."""
    whole = load(tokenizer_path).whole_tokens()  # found out once, for all workers
    return _add(df, text, ids, pa.list_(pa.int32()), T.ArrayType(T.IntegerType()), lambda b: load(tokenizer_path, whole).encode_all([t.decode() for t in b.texts()]), lambda: load(tokenizer_path, whole).forget())


def bpe_decode(df: DataFrame, tokenizer_path: str, *, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """df with `text`, decoded from `ids`; bytes that are no UTF-8 become U+FFFD, null ids are none.  Special tokens are spelled out.  An id outside the vocabulary is an error."""
    keep = [c for c in df.columns if c != text]
    source = df.select(*[F.col(f"`{c}`") for c in keep])
    schema = T.StructType([*source.schema.fields, T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                yield pa.RecordBatch.from_arrays([*part.columns, spelling(tokenizer_path).decode(part.column(part.schema.get_field_index(ids)))], names=[*keep, text])

    return source.mapInArrow(run, schema)


def bpe_encode_decode(df: DataFrame, tokenizer_path: str, *, text: str = "text", ids: str = "ids", decoded: str = "decoded", keep_text: bool = True) -> DataFrame:
    """df with `ids` and `decoded` (without keep_text, and without the text): bpe_encode, then bpe_decode, in one pass.

    Rows go to a worker and back once, and a task holds one worker, not two.  Columns of these names are replaced.
    """
    whole = load(tokenizer_path).whole_tokens()
    keep = [c for c in df.columns if c not in (ids, decoded)]
    shown = [c for c in keep if keep_text or c != text]
    source = df.select(*[F.col(f"`{c}`") for c in keep])
    schema = T.StructType([*(source.schema[c] for c in shown), T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(decoded, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(tokenizer_path, whole)
        for batch in batches:
            for block in cut(batch, text, BLOCK):
                found, rows = tokenizer.encode_all([t.decode() for t in block.texts()]), block.batch.select(shown)
                for a in range(0, len(found), 256):
                    part = found.slice(a, 256)
                    yield pa.RecordBatch.from_arrays([*rows.slice(a, 256).columns, part, tokenizer.decode_all(part)], names=[*shown, ids, decoded])
        del tokenizer
        _loaded.pop(tokenizer_path, None)
        release()

    return source.mapInArrow(run, schema)


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers from 0 on, each in as few bytes a number as its greatest needs, compressed."""
    parts = [np.array([len(arrays), *map(len, arrays)], np.uint64).tobytes()]
    for a in arrays:
        kind = next(k for k in ("<u1", "<u2", "<u4", "<u8") if not len(a) or int(a.max()) < 1 << 8 * np.dtype(k).itemsize)
        parts += [np.dtype(kind).itemsize.to_bytes(1, "little"), a.astype(kind).tobytes()]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(parts))


def _unpacked(data) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, np.uint64, 1)[0])
    out, at = [], 8 * (n + 1)
    for size in np.frombuffer(raw, np.uint64, n, 8).tolist():
        width = raw[at]
        out.append(np.frombuffer(raw, f"<u{width}", size, at + 1).astype(np.int64))
        at += 1 + width * size
    return out


class _Pack:
    """Frequencies of pre-tokens of some documents, by bucket of pre-tokens."""

    def __init__(self, tokenizer: ByteBPE, name: str):
        self.tokenizer, self.name = tokenizer, name
        self.number: defaultdict[str, int] = defaultdict(numbers_from().__next__)
        self.rows: list[pa.RecordBatch] = []
        self.parts: tuple[list[np.ndarray], ...] = ([], [], [], [])
        self.bytes = 0

    def add(self, block: Block, rows: pa.RecordBatch) -> None:
        found = self.tokenizer.frequencies([t.decode() for t in block.texts()], self.number)
        for part, values in zip(self.parts, found):
            part.append(np.array(values, np.uint32))
        self.rows.append(rows)
        self.bytes += len(block.data)

    def send(self, buckets: int) -> Iterator[pa.RecordBatch]:
        """A row for each bucket, and one with the rows of the documents and their special tokens."""
        piece, times, distinct, special = map(np.concatenate, self.parts)
        doc = np.repeat(np.arange(len(distinct), dtype=np.uint32), distinct)
        pieces = list(self.number)
        digest = xxhash.xxh32_intdigest
        bucket = np.fromiter((digest(p) for p in pieces), np.int64, len(pieces)) % buckets
        by_bucket = np.argsort(bucket, kind="stable")
        place = np.empty(len(pieces), np.int64)
        place[by_bucket] = np.arange(len(pieces))
        of = place[piece]
        order = np.argsort(of, kind="stable")
        doc, times = doc[order], times[order]
        stand = np.bincount(of, minlength=len(pieces)).astype(np.uint32)
        ends = np.concatenate([[0], np.cumsum(stand, dtype=np.int64)])
        # documents of a pre-token rise, and so do the first ones of pre-tokens in the order they were met in: steps are small
        begin = ends[:-1]
        step = np.diff(doc.astype(np.int64), prepend=0)
        pack = zstandard.ZstdCompressor(level=3).compress
        cuts = np.flatnonzero(np.diff(bucket[by_bucket], prepend=-1)).tolist()
        out = []
        for a, z in zip(cuts, [*cuts[1:], len(pieces)]):
            spelled = [pieces[i] for i in by_bucket[a:z].tolist()]
            within = slice(ends[a], ends[z])
            step[begin[a:z]] = np.diff(doc[begin[a:z]].astype(np.int64), prepend=0)
            sizes = np.fromiter(map(len, spelled), np.uint32, len(spelled))
            out.append((int(bucket[by_bucket[a]]), self.name, pack("".join(spelled).encode()), _packed(sizes, stand[a:z], step[within], times[within]), None))
        rest = pa.Table.from_batches(self.rows).append_column("special", pa.array(special.astype(np.int64)))
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rest.schema) as stream:
            stream.write_table(rest)
        out.append((digest(self.name) % buckets, self.name, None, None, sink.getvalue().to_pybytes()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.string(), *[pa.binary()] * 3))], names=["bucket", "pack", "pieces", "numbers", "rest"])


def _summed(table: pa.Table, tokenizer: ByteBPE) -> pa.Table:
    """Of a bucket: each distinct pre-token measured once, joined to the frequencies, and added up for each document."""
    unpack = zstandard.ZstdDecompressor().decompress
    number: defaultdict[str, int] = defaultdict(numbers_from().__next__)
    rows = []
    for name, pieces, numbers, rest in zip(*(table.column(c) for c in ("pack", "pieces", "numbers", "rest"))):
        if rest.is_valid:
            rows.append((name.as_py(), None, rest.as_py()))
            continue
        sizes, stand, step, times = _unpacked(numbers.as_buffer())
        text = unpack(pieces.as_buffer()).decode()
        ends = list(accumulate(sizes.tolist(), initial=0))
        of = np.fromiter((number[text[a:z]] for a, z in zip(ends, ends[1:])), np.int64, len(sizes))
        begin = np.cumsum(stand) - stand
        first = np.cumsum(step[begin])
        step[begin] = 0
        on = np.cumsum(step)
        rows.append((name.as_py(), of, (stand, on + np.repeat(first - on[begin], stand), times)))
    size = tokenizer.measure(list(number))
    tokenizer.forget()
    out = []
    for name, of, values in rows:
        if of is None:
            out.append((name, None, values))
            continue
        stand, doc, times = values
        docs, where = np.unique(doc, return_inverse=True)
        total = np.bincount(where, weights=times * np.repeat(size[of], stand), minlength=len(docs)).astype(np.int64)  # exact: below 2^53
        out.append((name, _packed(np.diff(docs, prepend=0), total), None))
    return pa.table([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.binary(), pa.binary()))], names=["pack", "sums", "rest"])


def token_counts(df: DataFrame, tokenizer_path: str, *, text: str = "text", count: str = "n_tokens", keep_text: bool = True) -> DataFrame:
    """df with `count`, the number of tokens of the text (without keep_text, instead of the text).

    Two shuffles: frequencies of pre-tokens go to the buckets of the pre-tokens, where each distinct one is counted once, and
    sums go back to the documents.  A very common pre-token is an entry for each document in its bucket, a few bytes, and
    buckets grow in number with the text, so none is much greater than the others.
    """
    columns = [c for c in df.columns if c != count]
    shown = [c for c in columns if keep_text or c != text]
    source = df.select(*[F.col(f"`{c}`") for c in columns])
    whole = load(tokenizer_path).whole_tokens()
    total = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_BYTES))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, task = load(tokenizer_path, whole), TaskContext.get().partitionId()
        names = (f"{task}-{i}" for i in numbers_from())
        held = _Pack(tokenizer, next(names))
        for batch in batches:
            for block in cut(batch, text, BLOCK):
                held.add(block, block.batch.select(shown))
                if held.bytes >= PACK_BYTES:
                    yield from held.send(buckets)
                    held = _Pack(tokenizer, next(names))
        if held.rows:
            yield from held.send(buckets)
        del held
        release()

    def unite(table: pa.Table) -> pa.Table:
        rest = next(x for x in table.column("rest") if x.is_valid)
        rows = pa.ipc.open_stream(rest.as_buffer()).read_all()
        out = rows.column(rows.num_columns - 1).to_numpy().copy()
        for sums in table.column("sums"):
            if sums.is_valid:
                steps, counts = _unpacked(sums.as_buffer())
                out[np.cumsum(steps)] += counts
        return pa.table([*rows.columns[:-1], pa.array(out)], names=[*shown, count])

    packed = source.mapInArrow(pack, "bucket int, pack string, pieces binary, numbers binary, rest binary")
    summed = packed.groupBy("bucket").applyInArrow(lambda t: _summed(t, load(tokenizer_path, whole)), "pack string, sums binary, rest binary")
    return summed.groupBy("pack").applyInArrow(unite, T.StructType([*(source.schema[c] for c in shown), T.StructField(count, T.LongType())]))
