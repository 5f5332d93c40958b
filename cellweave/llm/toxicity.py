"""Toxicity by a weighted finite-state pattern grammar over clauses.

A lexical transducer writes a text as a line of symbols: insult, suspect, threat, target, negation, report, other, clause end.
Insults and suspects come from short lists and from labelled rows: fronts of words, and words, that stand in toxic texts far
more often (insults) or more often (suspects) than in others.  Small sequential transducers then rewrite the line, each with
one thing to say, and are composed into one machine:

* near_target marks insults, suspects and threats that a target stands near (it runs from right to left for targets behind
  them, and from left to right for those before);
* negation marks what a negation holds for, the next few words of its clause;
* reported marks what stands behind a verb of reporting in its clause;
* clause reads marks and puts out one symbol for each clause that anything matched in: the kind of its weightiest match.

A word by itself scores nothing: an insult, listed or learned, counts as what its clause makes of it.  The numbers of matched
clauses by kind are scored by a logistic model, fitted to the labelled rows, in which each kind has a weight for being there
and one for each doubling of its number (a weightier kind has those of the lighter ones of its sort as well); suspects also
have one for each doubling of the clauses they are found among.

Learning reads at most about `sample` labelled rows for words (the bound holds whatever the table's size), less copies, and
all training rows for the weights, as a table by the powers of two that the numbers lie between.  Labels, language, source and
id are no inputs of a score.

Cases: null and empty texts have no clauses and get the model's base rate; repeated rows get equal scores; rows without a
label are scored but not learned from; with no labels at all the listed words and built-in weights hold; of several labels of
an id the greatest holds; very long texts are read whole; extra columns are not read, whatever they are called.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import cached_property, lru_cache, reduce

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import cut
from .minhash import sketches
from .shared import keep

#: Labelled rows from which words are learned, about.
SAMPLE_ROWS = 20_000
#: Kinds of matched clauses, the weightiest first, and their marks.
KINDS = ("threatening", "personal", "plain", "weak personal", "weak", "reported", "negated", "weak reported", "weak negated")
MARKS = "kpiqsuxvy"
#: Places of the kinds that each kind's weights hold for: its own and those of weightier ones of its sort.
HOLDS = ((0,), (0, 1), (0, 1, 2), (3,), (3, 4), (5,), (6,), (7,), (8,))
#: What a kind weighs where nothing is learned.
PRIOR_WEIGHTS = (0.5, 1.0, 5.0, 0.5, 1.0, 1.0, 0.5, 0.2, 0.1)
#: Words after a negation that it holds for; words from a target to the insult it makes personal.
NEGATED_WORDS, TARGET_WORDS = 3, 4
#: Lengths of the fronts of words that count as features.
FRONTS = range(4, 9)
#: How many times as often as in others a word or front must stand in toxic texts to be an insult, or a suspect; a common one is a suspect at less.
INSULT_RATIO, SUSPECT_RATIO, COMMON_RATIO = 200, 30, 4

# Words of English, German, French and Spanish.
INSULTS = frozenset("idiot idiots moron morons stupid dumb imbecile scum scumbag trash loser losers pathetic worthless disgusting clown filth vermin bastard bitch asshole cretin dummkopf abschaum arschloch connard crétin ordure idiota imbécil basura".split())
THREATS = frozenset("kill murder strangle stab shoot hang burn beat destroy hurt töten umbringen erschießen tuer étrangler frapper matar quemar golpear".split())
TARGETS = frozenset("you your yours youre u he she they them him her these those people all everyone du dich dir ihr euch sie tu te toi vous il elle ils eres usted ustedes ellos".split())
NEGATIONS = frozenset("not no never nobody neither nor without isn't aren't wasn't don't doesn't didn't won't can't nicht kein keine keiner nie niemand ne pas jamais aucun sans nunca ni sin tampoco".split())
REPORTS = frozenset("said says say saying wrote writes quoted quotes claimed claims called reported according told sagte sagt schrieb behauptete dit écrit affirme dijo dice escribió".split())

#: What the lexical transducer writes: insult, suspect, threat, target, negation, report, other word, clause end.
SYMBOLS = "ishtnrw."
_TOKEN = regex.compile(r"[^\x00-\x26\x28-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+|[.!?;:\n]")
#: Clauses with something to match.
_CLAUSE = regex.compile(r"[^.]*[ihs][^.]*")


@dataclass(frozen=True)
class Transducer:
    """A sequential weighted transducer.  arcs: (state, symbol) -> (next state, what is written, one symbol or none, weight)."""

    start: int
    arcs: dict[tuple[int, str], tuple[int, str, float]]

    def run(self, line: str) -> tuple[str, float]:
        """What is written for the line, and the weights of its arcs added up."""
        state, out, total, arcs = self.start, [], 0.0, self.arcs
        for symbol in line:
            state, written, weight = arcs[state, symbol]
            if written:
                out.append(written)
            total += weight
        return "".join(out), total


def compose(first: Transducer, second: Transducer) -> Transducer:
    """The transducer that writes what second writes of what first writes."""
    symbols: dict[int, list[str]] = {}
    for state, symbol in first.arcs:
        symbols.setdefault(state, []).append(symbol)
    number = {(first.start, second.start): 0}
    todo, arcs = [(first.start, second.start)], {}
    while todo:
        p, q = pair = todo.pop()
        for symbol in symbols.get(p, ()):
            p2, written, weight = first.arcs[p, symbol]
            q2, out = q, ""
            if written:
                q2, out, more = second.arcs[q, written]
                weight += more
            if (p2, q2) not in number:
                number[p2, q2] = len(number)
                todo.append((p2, q2))
            arcs[number[pair], symbol] = (number[p2, q2], out, weight)
    return Transducer(0, arcs)


def near_target(words: int = TARGET_WORDS) -> Transducer:
    """i, s, h become p, q, k where a target stands at most so many words before, in the same clause.  State: words since the target."""
    arcs = {}
    for since in range(words + 1):
        for symbol in SYMBOLS + "pqk":
            near = since < words and symbol in "ish"
            after = words if symbol == "." else 0 if symbol == "t" else min(words, since + 1)
            arcs[since, symbol] = (after, dict(zip("ish", "pqk"))[symbol] if near else symbol, 0.0)
    return Transducer(words, arcs)


def negation(words: int = NEGATED_WORDS) -> Transducer:
    """Strong marks become x, weak ones y, for so many words after a negation in the same clause.  State: words that it still holds for."""
    arcs = {}
    for left in range(words + 1):
        for symbol in SYMBOLS + "pqk":
            after = 0 if symbol == "." else words if symbol == "n" else max(0, left - 1)
            arcs[left, symbol] = (after, ("x" if symbol in "ipk" else "y" if symbol in "sq" else symbol) if left else symbol, 0.0)
    return Transducer(0, arcs)


def reported() -> Transducer:
    """Strong marks become u, weak ones v, after a verb of reporting in the same clause.  State: whether there was one."""
    arcs = {}
    for told in (0, 1):
        for symbol in SYMBOLS + "pqkxy":
            after = 0 if symbol == "." else int(told or symbol == "r")
            arcs[told, symbol] = (after, ("u" if symbol in "ipk" else "v" if symbol in "sq" else symbol) if told else symbol, 0.0)
    return Transducer(0, arcs)


def clause(weights: tuple[float, ...] = PRIOR_WEIGHTS) -> Transducer:
    """At the end of a clause the mark of its weightiest match, if any, with the kind's weight.  State: place of the weightiest so far in MARKS."""
    arcs = {}
    none = len(MARKS)
    for best in range(none + 1):
        for symbol in SYMBOLS + "pqkxyuv":
            if symbol == ".":
                arcs[best, symbol] = (none, MARKS[best] if best < none else "", weights[best] if best < none else 0.0)
            else:
                arcs[best, symbol] = (min(best, MARKS.find(symbol)) if symbol in MARKS else best, "", 0.0)
    return Transducer(none, arcs)


@lru_cache
def machines() -> tuple[Transducer, Transducer]:
    """(the one that runs from right to left, those that run from left to right, composed)."""
    return near_target(), reduce(compose, [near_target(), negation(), reported(), clause()])


@dataclass
class Grammar:
    """Lexicon and weights."""

    words: frozenset[str] = INSULTS
    fronts: frozenset[str] = frozenset()
    suspects: frozenset[str] = frozenset()
    bias: float = -3.0
    weights: tuple[float, ...] = (*(x for w in PRIOR_WEIGHTS for x in (w, 0.3)), 0.0)
    _memory: dict = field(default_factory=dict, repr=False, compare=False)
    _clauses: dict = field(default_factory=dict, repr=False, compare=False)

    @cached_property
    def stems(self) -> frozenset[str]:
        """The shortest fronts of all entries: most words have none of them and need no further look."""
        return frozenset(f[: FRONTS[0]] for f in self.fronts | self.suspects)

    def symbol(self, word: str) -> str:
        """The lexical transducer: i insult, s suspect, h threat, t target, n negation, r report, . clause end, w other."""
        if word in (".", "!", "?", ";", ":", "\n"):
            return "."
        known = word[: FRONTS[0]] in self.stems
        if word in self.words or known and any(word[:n] in self.fronts for n in FRONTS if n <= len(word)):
            return "i"
        if word in THREATS:
            return "h"
        if known and any(word[:n] in self.suspects for n in FRONTS if n <= len(word)):
            return "s"
        return "n" if word in NEGATIONS else "t" if word in TARGETS else "r" if word in REPORTS else "w"

    def symbols(self, text: str) -> str:
        memory = self._memory
        if len(memory) > 200_000:
            memory.clear()
        out = []
        for word in _TOKEN.findall(text.lower()):
            s = memory.get(word)
            if s is None:
                s = memory[word] = self.symbol(word)
            out.append(s)
        return "".join(out)

    def kinds(self, text: str) -> str:
        """The mark of each matched clause."""
        return self._kinds(self.symbols(text))

    def _kinds(self, line: str) -> str:
        """A machine starts each clause anew, so clauses without anything to match are left out, and others are looked up."""
        memory, out = self._clauses, []
        if len(memory) > 200_000:
            memory.clear()
        for one in _CLAUSE.findall(line):
            kind = memory.get(one)
            if kind is None:
                backward, forward = machines()
                kind = memory[one] = forward.run(backward.run(f".{one}."[::-1])[0][::-1])[0]
            out.append(kind)
        return "".join(out)

    def counts(self, text: str) -> list[int]:
        """Matched clauses by kind, and clauses altogether."""
        line = self.symbols(text)
        kinds = self._kinds(line)
        return [*map(kinds.count, MARKS), line.count(".") + 1]


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from: those with crc32(doc_id as text) mod 5 = 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of a batch in which each word or front of a word stands: (feature, toxic texts, others)."""
    for batch in batches:
        for block in cut(batch):
            counts: dict[str, list[int]] = {}
            labels = block.column("toxic").to_pylist()
            for text, label in zip(block.texts(), labels):
                found = {w for w in _TOKEN.findall(text.decode().lower()) if len(w) > 2}
                for w in list(found):
                    found.update("^" + w[:n] for n in FRONTS if n <= len(w))
                for w in found:
                    counts.setdefault(w, [0, 0])[0 if label else 1] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([x[0] for x in counts.values()], pa.int64()), pa.array([x[1] for x in counts.values()], pa.int64())], names=["feature", "toxic", "other"])


def _one_of_copies(labelled: DataFrame) -> DataFrame:
    """(text, toxic): of rows of equal text, and then of those that share a band of min-hashes of five-word shingles, twice over, the one of the least id."""
    rows = labelled.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic"))
    rows = keep(rows.withColumn("text_key", F.xxhash64("text")), "toxicity sample")
    left = rows.join(sketches(rows).withColumnRenamed("text_key", "k"), F.col("text_key") == F.col("k"), "left").select("doc_id", "text_key", "bands")
    for band in (0, 1):
        same = F.coalesce(F.get("bands", F.lit(band)), "text_key")
        left = left.groupBy(same.alias("band")).agg(F.min(F.struct("doc_id", "text_key", "bands")).alias("row")).select("row.*")
    # keys of about SAMPLE_ROWS rows
    return rows.join(F.broadcast(left.select(F.col("text_key").alias("k"))), F.col("text_key") == F.col("k"), "left_semi").select("text", "toxic")


def learn_lexicon(labelled: DataFrame) -> Grammar:
    """A grammar without fitted weights, from rows (doc_id, text, toxic), few enough for a worker.

    Words and fronts of words count that stand in one of 250 toxic texts and SUSPECT_RATIO times as often as in others, or in
    one of 50 and COMMON_RATIO times as often.

    Of copies one counts.
    """
    labelled = keep(_one_of_copies(labelled), "toxicity sample without copies")
    n = labelled.agg(F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0)), F.count(F.lit(1))).first()
    toxic, other = n[0] or 0, n[1] - (n[0] or 0)
    if not toxic or not other:
        return Grammar()
    least = max(5, math.ceil(toxic / 250))
    rows = labelled.mapInArrow(_features, "feature string, toxic bigint, other bigint")
    rows = rows.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    rows = rows.withColumn("ratio", (F.col("toxic") / toxic) / ((F.col("other") + 0.5) / other))
    enough = (F.col("ratio") >= SUSPECT_RATIO) | (F.col("toxic") >= max(least, toxic / 50)) & (F.col("ratio") >= COMMON_RATIO)
    rows = rows.where((F.col("toxic") >= least) & enough)
    return sort_out({r["feature"]: (r["toxic"], r["ratio"]) for r in rows.collect()})


def sort_out(found: dict[str, tuple[int, float]]) -> Grammar:
    """Insults and suspects from features (toxic texts, ratio); fronts are marked by "^".

    The shortest front found stands for its family; longer ones count only where most of the family's toxic texts have them.
    """
    insults, suspects = set(), set()
    for f in sorted(f for f in found if f[0] == "^"):
        roots = [f[: n + 1] for n in FRONTS if n < len(f) - 1 and f[: n + 1] in found]
        if not roots:
            (insults if found[f][1] >= INSULT_RATIO else suspects).add(f[1:])
        elif found[f][1] >= INSULT_RATIO and found[f][0] >= 0.8 * found[roots[0]][0]:
            insults.add(f[1:])
    short = {f for f in found if f[0] != "^" and len(f) < FRONTS[0] and found[f][1] >= INSULT_RATIO}
    return Grammar(frozenset(short | INSULTS), frozenset(insults), frozenset(suspects))


def levels(counts: list[int]) -> list[int]:
    """The numbers of binary digits: 0 for 0, 1 for 1, 2 for 2 and 3, and so on."""
    return [c.bit_length() for c in counts]


def inputs(levels: list[int]) -> list[float]:
    """Of levels(): for each kind whether there is any, and its doublings; and the doublings of the clauses that suspects alone are found among."""
    *kinds, clauses = levels
    held = [max(kinds[i] for i in places) for places in HOLDS]
    weak = [x for k, x in zip(KINDS, kinds) if k.startswith("weak")]
    return [*(float(v) for x in held for v in (x > 0, max(0, x - 1))), float(clauses) if any(weak) else 0.0]


def fit(cells: list[tuple[list[int], int, int]], *, rounds: int = 60, ridge: float = 1.0) -> tuple[float, tuple[float, ...]]:
    """Bias and weights of a logistic model from (levels, toxic rows, other rows), by Newton's method with a ridge."""
    x = np.array([(1, *inputs(c)) for c, _, _ in cells], float)
    t, o = (np.array([c[i] for c in cells], float) for i in (1, 2))
    w = np.zeros(x.shape[1])
    penalty = np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        gradient = x.T @ ((t + o) * p - t) + penalty @ w
        hessian = (x * ((t + o) * p * (1 - p))[:, None]).T @ x + penalty
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), tuple(float(v) for v in w[1:])


def training_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic), one row for each labelled id that is not held out; of several labels the greatest holds."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    return known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def lexicon_of(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE_ROWS) -> Grammar:
    """learn_lexicon() of docs (doc_id, text) whose labels are in training_labels(), about `sample` of them, chosen by hash of the id."""
    n = labels.count()
    if not n:
        return Grammar()
    share = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1e6 * min(1.0, sample / n)))
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull())
    return learn_lexicon(texts.join(F.broadcast(share), "doc_id"))  # about `sample` ids at most


def count(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """(doc_id, clauses) of each row of docs (doc_id, text): matched clauses by kind, and clauses altogether."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in cut(batch):
                counts = [grammar.counts(t.decode()) for t in block.texts()]
                yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(counts, pa.list_(pa.int32()))], names=["doc_id", "clauses"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, clauses array<int>")


def _levels(clauses: Column) -> Column:
    return F.transform(clauses, lambda c: F.when(c > 0, F.length(F.bin(c))).otherwise(0))


def weigh(grammar: Grammar, counted: DataFrame, labels: DataFrame) -> Grammar:
    """The grammar with a bias and weights fitted to count() of the labelled rows."""
    rows = counted.join(labels, "doc_id").groupBy(_levels(F.col("clauses")).alias("levels")).agg(F.sum("toxic").alias("toxic"), F.count(F.lit(1)).alias("n")).collect()
    if not rows or not 0 < sum(r["toxic"] for r in rows) < sum(r["n"] for r in rows):
        return grammar
    bias, weights = fit([(list(r["levels"]), r["toxic"], r["n"] - r["toxic"]) for r in rows])
    return replace(grammar, bias=bias, weights=weights)


def score(counted: DataFrame, grammar: Grammar) -> DataFrame:
    """count() with score and predicted."""
    out = counted.withColumn("__levels", _levels(F.col("clauses")))
    level = lambda i: F.get("__levels", F.lit(i))
    z = F.lit(float(grammar.bias))
    for i, places in enumerate(HOLDS):
        there, doubled = (F.lit(float(w)) for w in grammar.weights[2 * i : 2 * i + 2])
        held = reduce(F.greatest, map(level, places))
        z = z + F.when(held > 0, there + doubled * (held - 1)).otherwise(F.lit(0.0))
    weak = reduce(lambda a, b: a | b, [level(i) > 0 for i, k in enumerate(KINDS) if k.startswith("weak")])
    z = z + F.when(weak, F.lit(float(grammar.weights[-1])) * level(len(KINDS))).otherwise(F.lit(0.0))
    out = out.withColumn("score", 1 / (1 + F.exp(-z))).drop("__levels")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
