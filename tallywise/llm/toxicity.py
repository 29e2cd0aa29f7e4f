"""Toxicity behind disguises: a noisy-channel decoder, then a scorer of the restored text.

What a writer typed is seen as a clean word sent through a channel that swaps
letters for look-alikes, puts marks or spaces between letters and repeats
letters. A Viterbi search over the lattice of possible clean characters finds
the likeliest word under a character trigram model of the whole corpus. Words
that no channel can have changed are their own only path and pass as they are.
The scorer is a sparse logistic regression on the words of the restored text
and their beginnings.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tallywise.llm.common import held_out, prepare_workers, text_or_empty
from tallywise.llm.learn import ftrl, labelled_sample, sample_features, with_texts

BUCKETS = 1 << 20
BEGINNINGS = (4, 5, 6)
BEGINS = crc32(b"^")  # marks a beginning
SAMPLE = 6_000  # labelled rows that the scorer is fitted on
EPOCHS = 3
CALIBRATE = 5  # parts of them, each judged by weights of the others, that set the shift of the scores
THRESHOLD = 0.5
CACHE = 150_000  # words whose score a worker remembers

# the channel: what a sign may stand for
SIGNS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a",
         "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i",
         "*": "abcdefghijklmnopqrstuvwxyz", "#": "h"}
FILLERS = set(".-_*~'·, /\\^=:")
SWAP, FILL, STRETCH, WILD, EDGE = -1.0, -1.0, -0.7, -3.5, -4.0  # log costs of a sign, a filler, a repeated or masked letter, a real mark
PATHS = 8  # readings that count where signs leave more than one
GAP = 30.0  # and none less likely than the best by more than this (natural log)
MASK = "\0"  # any letter
BLOCK = 256  # places whose costs are held at a time
SHORT = 4  # places of an end of a token whose costs a worker remembers
ENDS = 64  # such ends, a few kilobytes each
LETTERS = "abcdefghijklmnopqrstuvwxyz"

SYMBOLS = 28  # 0 edge, 1 to 26 letters a to z, 27 any other letter
OTHER = 27
BYTE_SYMBOL = np.array([27 if b >= 0x80 else b - 96 if 97 <= b <= 122 else b - 64 if 65 <= b <= 90 else 0
                        for b in range(256)], np.int64)

WORD = regex.compile(r"\S+")
RUN = re.compile(r"(.)\1+")
LONG_RUN = re.compile(r"(.)\1\1")
SPACED = regex.compile(r"(?<!\S)(?:[^\s\p{P}][ ]){2,}[^\s\p{P}](?!\S)|(?<!\S)(?:[\p{L}\p{N}@$!|*+][ .\-_*]){3,}[\p{L}\p{N}@$!|*+](?!\S)")
SINGLES = re.compile(r"(?<!\S).[ .\-_*].[ .\-_*].", re.DOTALL)  # every match of SPACED begins so; found faster
TRIM = ".,;:!?\"'()[]{}<>«»„“”…#%&*$~-_/\\=^`|+"
MARKS = "".join(c for c in TRIM if c not in SIGNS)  # never part of a word at its ends
TRIM_LEFT = TRIM.replace("$", "").replace("(", "").replace("|", "").replace("!", "").replace("*", "")


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """Character trigrams of all texts; at most SYMBOLS ** 3 rows reach the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS ** 3, np.int64)
        for batch in batches:
            for body in batch.column("body").to_pylist():
                for start in range(0, len(body), 1 << 20):
                    s = BYTE_SYMBOL[np.frombuffer(body[max(0, start - 2):start + (1 << 20)], np.uint8)]
                    total += np.bincount(s[:-2] * SYMBOLS ** 2 + s[1:-1] * SYMBOLS + s[2:], minlength=SYMBOLS ** 3)
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["gram", "n"])

    out = np.zeros(SYMBOLS ** 3)
    rows = docs.select(F.col("body").cast("binary").alias("body"))
    for gram, n in rows.mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n")).collect():
        out[gram] = n
    return out


@dataclass
class Language:
    """log P(c | a, b): as a list by trigram number, as a table, and the longest run of ``*`` that can still mask letters."""
    logs: list[float]
    table: np.ndarray
    longest: int
    ends: dict = field(default_factory=dict)  # costs of short ends of tokens


def language_model(counts: np.ndarray) -> Language:
    """The character model of trigram counts; backs off to P(c | b).

    Any reading of n masked letters has a rival that takes the run as one filler
    and goes on alike. After two more letters both stand in the same state, so
    the rival leads by at least ``n * -WILD + FILL - 2 * worst``, worst being the
    highest cost of one letter. Where that is over GAP, masking never counts.
    """
    three = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    two = three.sum(axis=0) + 0.5
    low = two / two.sum(axis=1, keepdims=True)
    table = np.log((three + 5 * low) / (three.sum(axis=2, keepdims=True) + 5))
    return Language(table.reshape(-1).tolist(), table, math.floor((GAP - FILL - 2 * float(table.min())) / -WILD))


def symbol(char: str) -> int:
    return ord(char) - 96 if "a" <= char <= "z" else OTHER


def steps(text: str, longest: int) -> Iterator[list[tuple[str, float]]]:
    """What stands at each place: all (clean characters, log cost); a space is the edge of a word, MASK any letter.

    A run of one letter is that letter once or twice. So is a run of three or
    more equal signs, which may also be one filler or one edge; a run of ``*``
    masks one letter each. One or two equal signs are read sign by sign.
    """
    at = 0
    while at < len(text):
        char, start, at = text[at], at, at + 1
        while at < len(text) and text[at] == char:
            at += 1
        run = at - start
        if char.isalpha() and char not in SIGNS:
            yield [(char, 0.0)] if run == 1 else [(char, STRETCH), (char * 2, 0.0 if run == 2 else STRETCH)]
            continue
        if run < 3:
            at = start + 1
            run = 1
        out = [] if char not in FILLERS else [("", FILL)]
        out.append((" ", FILL if char == " " else EDGE))
        if char == "*":
            if run <= longest:
                out.append((MASK * run, WILD * run))
        else:
            for clean in SIGNS.get(char, ""):
                out.append((clean, SWAP if run == 1 else SWAP + STRETCH))
                if run > 1:
                    out.append((clean * 2, SWAP + STRETCH))
        yield out


def before(clean: str, ahead: np.ndarray, model: Language) -> list[np.ndarray]:
    """For the characters of ``clean``, the best log cost to the end from every state before each of them, and ``ahead``."""
    out = [ahead]
    for c in reversed(clean):
        if c == MASK:
            out.append((model.table[:, :, 1:OTHER] + out[-1][None, :, 1:OTHER]).max(axis=2))
        else:
            s = 0 if c == " " else symbol(c)
            out.append(model.table[:, :, s] + out[-1][:, s])
    return out[::-1]


def decode(text: str, model: Language, paths: int = 1) -> list[str]:
    """The ``paths`` likeliest clean forms of lower-case ``text`` by Viterbi; states are the last two symbols.

    From the first masked letter on, a backward search gives every state its best cost to the end.
    With that, no more than ``paths`` beginnings have to be kept at any place of the forward
    search: each of them is the beginning of another whole form, and those are
    the best ones. Costs are kept for a block of places at a time and worked out
    again from the block's end, so that memory stays small however long the text
    is. Before the first masked letter few states can be reached at a place, and
    the ``paths`` best ways to each of them are kept instead. Forms less likely than
    the best by a factor of over exp(GAP) do not count.
    """
    lattice = list(steps(text, model.longest))
    first = next((i for i, options in enumerate(lattice) if options[-1][0][:1] == MASK), len(lattice))
    ways = unmasked(lattice[:first], model, paths)
    if first < len(lattice):
        rest = lattice[first:]
        ways = ended(ways, rest, model, paths) if len(rest) <= SHORT else searched(ways, rest, model, paths)
    logs = model.logs
    found = sorted(((gain + logs[(a * SYMBOLS + b) * SYMBOLS], chain) for gain, a, b, chain in ways), key=lambda way: -way[0])[:paths]
    return [spelled(chain) for gain, chain in found if gain >= found[0][0] - GAP]


def unmasked(lattice: list[list[tuple[str, float]]], model: Language, paths: int) -> list[tuple]:
    """The ``paths`` best ways to every state that the end can be in, of a lattice without masked letters."""
    logs = model.logs
    ways = [(0.0, 0, 0, None)]
    for options in lattice:
        found = []
        for clean, cost in options:
            codes = [0 if c == " " else symbol(c) for c in clean]
            for gain, a, b, chain in ways:
                gain += cost
                for s in codes:
                    gain += logs[(a * SYMBOLS + b) * SYMBOLS + s]
                    a, b = b, s
                found.append((gain, a, b, (chain, clean) if clean else chain))
        if len(found) > paths:
            found.sort(key=lambda way: -way[0])
            kept: dict[tuple[int, int], list] = {}
            for way in found:
                best = kept.setdefault((way[1], way[2]), [])
                if len(best) < paths:
                    best.append(way)
            found = [way for best in kept.values() for way in best]
        ways = found
    return ways


def ended(ways: list[tuple], lattice: list[list[tuple[str, float]]], model: Language, paths: int) -> list[tuple]:
    """``searched`` for the few places at the end of a token: many tokens end alike, so the costs are remembered."""
    key = tuple(map(tuple, lattice))
    costs = model.ends.get(key)
    if costs is None:
        if len(model.ends) >= ENDS:
            model.ends.clear()
        ahead, costs = model.table[:, :, 0], []
        for options in reversed(lattice):
            costs.append((ahead, {clean: before(clean, ahead, model) for clean, _ in options if clean[:1] == MASK}))
            ahead = cost_before(options, ahead, model)
        costs.reverse()
        model.ends[key] = costs
    for options, (ahead, masks) in zip(lattice, costs):
        ways = best_ways([way for clean, cost in options for way in moved(ways, clean, cost, ahead, model, paths, masks.get(clean))], ahead, paths)
    return ways


def best_ways(found: list[tuple], ahead: np.ndarray, paths: int) -> list[tuple]:
    return found if len(found) <= paths else sorted(found, key=lambda way: -way[0] - ahead[way[1], way[2]])[:paths]


def searched(ways: list[tuple], lattice: list[list[tuple[str, float]]], model: Language, paths: int) -> list[tuple]:
    """The ``paths`` best ways on from ``ways`` through any lattice, by a backward and a forward search."""
    ends = {}  # costs after the last step of each block
    ahead = model.table[:, :, 0]
    for at in range(len(lattice) - 1, -1, -1):
        if (at + 1) % BLOCK == 0 or at + 1 == len(lattice):
            ends[at // BLOCK] = ahead
        ahead = cost_before(lattice[at], ahead, model)
    for block in range(len(ends)):
        part = lattice[block * BLOCK:(block + 1) * BLOCK]
        costs = [ends.pop(block)]
        for options in reversed(part[1:]):
            costs.append(cost_before(options, costs[-1], model))
        for options in part:
            ahead = costs.pop()
            ways = best_ways([way for clean, cost in options for way in moved(ways, clean, cost, ahead, model, paths)], ahead, paths)
    return ways


def cost_before(options: list[tuple[str, float]], ahead: np.ndarray, model: Language) -> np.ndarray:
    out = None
    for clean, cost in options:
        one = before(clean, ahead, model)[0] + cost
        out = one if out is None else np.maximum(out, one)
    return out


def moved(ways: list[tuple], clean: str, cost: float, ahead: np.ndarray, model: Language, paths: int,
          inner: list[np.ndarray] | None = None) -> list[tuple]:
    """``ways`` after ``clean``; of masked letters only the best ``paths`` ways, by their cost to the end too."""
    if clean[:1] == MASK:
        ways = [(gain + cost, a, b, chain) for gain, a, b, chain in ways]
        for left in (inner or before(clean, ahead, model))[1:]:
            one, two = [way[1] for way in ways], [way[2] for way in ways]
            gains = np.array([way[0] for way in ways])[:, None] + model.table[one, two, 1:OTHER]
            best = np.argsort(-(gains + left[two, 1:OTHER]), axis=None, kind="stable")[:paths]
            ways = [(float(gains[i, c]), two[i], c + 1, (ways[i][3], LETTERS[c])) for i, c in (divmod(int(k), OTHER - 1) for k in best)]
        return ways
    logs, out = model.logs, []
    codes = [0 if c == " " else symbol(c) for c in clean]
    for gain, a, b, chain in ways:
        gain += cost
        for s in codes:
            gain += logs[(a * SYMBOLS + b) * SYMBOLS + s]
            a, b = b, s
        out.append((gain, a, b, (chain, clean) if clean else chain))
    return out


def spelled(chain: tuple | None) -> str:
    parts = []
    while chain is not None:
        chain, clean = chain
        parts.append(clean)
    return "".join(reversed(parts))


def restored(token: str, model: Language) -> list[str]:
    """Clean words of one token without white space: itself if only letters, else decoded.

    Marks around a word are cut. Where they may stand for letters, the uncut
    token is read too. A token without letters is read if it mixes signs that
    stand for letters, and is not a number.
    """
    core = token.strip(MARKS)
    if core.isalpha() and not LONG_RUN.search(core):
        return [core]
    core = token.rstrip(TRIM).lstrip(TRIM_LEFT)
    readings = []
    if any(map(str.isalpha, core)):
        if not core.isalpha() or LONG_RUN.search(core):
            readings.append(core)
        if len(core) < len(token):
            whole = token.strip(MARKS)
            if len(core) < len(whole):
                readings.append(whole)
    elif all_signs(token.strip(MARKS)):
        readings.append(token.strip(MARKS))
    words = [core] if core.isalpha() and core not in readings else []
    for reading in readings:
        words += [word for way in decode(reading, model, PATHS) for word in way.split()]
    return list(dict.fromkeys(words))


def all_signs(token: str) -> bool:
    """Every character may stand for a letter, there are several, and not all are digits."""
    return len(set(token)) > 1 and not token.isdigit() and all(c in SIGNS for c in token)


def spelled_out(low: str, model: Language) -> Iterator[str]:
    """Words of stretches of single letters, in all their readings."""
    for spaced in SPACED.findall(low) if SINGLES.search(low) else ():
        for way in decode(spaced, model, PATHS):
            yield from way.split()


def word_features(word: str) -> set[int]:
    """The word and its beginnings, each run of a letter as one."""
    if RUN.search(word):
        word = RUN.sub(r"\1", word)
    raw, size = word.encode("utf-8", "replace"), len(word)
    out = {crc32(raw) % BUCKETS}
    if len(raw) == size:
        for n in BEGINNINGS:
            if size < n:
                break
            out.add(crc32(raw[:n], BEGINS) % BUCKETS)
        return out
    for n in BEGINNINGS:
        if size >= n:
            out.add(crc32(word[:n].encode("utf-8", "replace"), BEGINS) % BUCKETS)
    return out


NONE: frozenset[int] = frozenset()


@dataclass
class Scorer:
    grams: Language
    weights: dict[int, float]
    bias: float

    def features(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        seen: set[int] = set()
        low = text.lower()
        for token in set(low.split()):
            for word in restored(token, self.grams):
                seen |= word_features(word)
        for word in spelled_out(low, self.grams):
            seen |= word_features(word)
        at = np.array(sorted(seen), np.int64)
        return at, np.ones(len(at), np.int64)

    def hits(self, words: Iterable[str]) -> frozenset[int]:
        """Features that have a weight; few words have any."""
        weights = self.weights
        found = [f for word in words for f in word_features(word) if f in weights]
        return frozenset(found) if found else NONE

    def score(self, text: str, cache: dict[str, frozenset[int]]) -> float:
        low = text.lower()
        found: set[int] = set()
        for token in set(low.split()):
            if (got := cache.get(token)) is None:
                if len(cache) >= CACHE:
                    cache.clear()
                got = cache[token] = self.hits(restored(token, self.grams))
            if got:
                found |= got
        found |= self.hits(spelled_out(low, self.grams))
        total = self.bias + sum(self.weights[f] for f in found)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, total))))


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, float]:
    weights, bias = ftrl(rows, BUCKETS, 2, EPOCHS, alpha=0.15, beta=1.0, l1=1.2, l2=0.05)
    return weights[:, 1] - weights[:, 0], float(bias[1] - bias[0])


def best_shift(logits: np.ndarray, labels: np.ndarray) -> float:
    """What to add so that the cut at 0 gives held-back rows the best F1; the penalty leaves scores too low."""
    tries = np.linspace(-2, 2, 41)
    f1 = np.array([2 * ((logits + t > 0) & (labels == 1)).sum() / max(1, (logits + t > 0).sum() + labels.sum()) for t in tries])
    return float(tries[f1 == f1.max()].mean()) if labels.any() else 0.0


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", sample: int = SAMPLE) -> Scorer:
    """Trigrams from all texts, weights from labelled rows whose crc32 of the id mod 5 is not 0."""
    prepare_workers(spark)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_or_empty(text_col).alias("body"))
    scorer = Scorer(language_model(trigram_counts(rows)), {}, 0.0)
    known = labels.select("doc_id", F.col(f"`{label_col}`").cast("int").alias("label")).where("label in (0, 1)")
    picked = labelled_sample(with_texts(rows, known.where(~held_out(5, 0))), sample)
    held = sample_features(rows.where(~held_out(5, 0)), picked, scorer.features)
    kinds = {label for label, _, _ in held}
    if len(kinds) < 2:
        scorer.bias = {0: -20.0, 1: 20.0}.get(next(iter(kinds), 2), 0.0)
        return scorer
    logits = np.zeros(len(held))
    for part in range(CALIBRATE):  # every row is judged by weights that have not seen it
        gap, bias = fit([row for i, row in enumerate(held) if i % CALIBRATE != part])
        logits[part::CALIBRATE] = [gap[at].sum() + bias for _, at, _ in held[part::CALIBRATE]]
    shift = best_shift(logits, np.array([label for label, _, _ in held]))
    gap, bias = fit(held)
    scorer.weights = {int(i): float(gap[i]) for i in np.nonzero(gap)[0]}
    scorer.bias = bias + shift
    return scorer


def score_toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   label_col: str = "toxic", sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    Null and empty texts get the score of a text without known words. With
    labels of one kind only, every score is near that label; without any it is
    0.5. Labels other than 0 and 1 are ignored, repeated ones count once. Null
    ids are scored and not learned from; repeated rows get the same score; an
    empty table gives an empty result; other columns are ignored.
    """
    scorer = train(spark, docs, labels, id_col, text_col, label_col, sample)
    shared = spark.sparkContext.broadcast(scorer)  # at most BUCKETS weights
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), held_out(5, 0, id_col).alias("held_out"),
                       text_or_empty(text_col).alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, cache = shared.value, {}
        for batch in batches:
            scores = [own.score(text, cache) for text in batch.column("body").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()),
                 pa.array([int(s >= threshold) for s in scores], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(run, rows.select("doc_id", "held_out").schema.add("score", T.DoubleType())
                           .add("predicted", T.IntegerType()))
