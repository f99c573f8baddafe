"""Language identification by segmentation-marginalised unigrams.

The pieces are all letter-only entries of a fixed public vocabulary, as bytes, and all single bytes. A language gives each
piece a probability; a word's probability is the sum over all its segmentations of the product of its pieces', which the
forward algorithm computes in one pass over the word. Words are runs of letters, lower-cased. Piece probabilities come
from expectation-maximisation over word counts: a Spark job per round returns expected counts by (language, piece), at
most languages times vocabulary rows.

The model is fitted on at most about ``train_docs`` labelled documents, chosen by hash within each language, of
which rare ones keep all of theirs, and on words of at most ``TRAIN_BYTES`` bytes; everything is scored.
Forward and backward run on arrays of equally long words, in logarithms where words are long, and a worker keeps the scores
of up to ``CACHE`` words.

Defined results: null text, and text without a letter, is ``und`` with score 0; null lang is never learned; with nothing
to learn from everything is ``und``; ties go to the first language in code-point order; repeated rows give repeated
results; ``held_out`` is false for a null doc_id; other columns, whatever their names, are kept by ``of_stated_language``.
A very long text is one row, scored in chunks; a word of any length is scored whole.
"""

from __future__ import annotations

import base64
import re
from collections import Counter, deque
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import appended, read, scratch, written

#: Where the vocabulary lies, unless the session's ``spark.tidewater.language.vocabulary`` says otherwise.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Bytes up to which a word's probability needs no logarithms, and above which a word is worked on in chunks of as many.
SHORT, LONG = 32, 1024
CACHE = 100_000
#: Bytes of equally long words that are worked on at once.
STEP = 30_000
WORD = re.compile(r"[^\W\d_]+")
_STEP = np.uint64(0x9E3779B97F4A7C15)


def pieces_of(path: str = VOCABULARY) -> list[bytes]:
    """Letter-only pieces of a rank file, lower-cased, without leading space, and all single bytes."""
    found = {bytes([b]) for b in range(256)}
    with open(path, "rb") as f:
        for line in f:
            piece = base64.b64decode(line.split()[0]).decode("utf-8", "ignore").strip().lower()
            if piece.isalpha():
                found.add(piece.encode())
    return sorted(found)


def vocabulary_of(spark: SparkSession) -> list[bytes]:
    return pieces_of(spark.conf.get("spark.tidewater.language.vocabulary", VOCABULARY))


class Pieces:
    """Piece numbers of all substrings of equally long words, by hashes that run along the words; hits are verified."""

    def __init__(self, pieces: list[bytes]) -> None:
        self.n = len(pieces)
        self.tables = {}
        for length in sorted({len(p) for p in pieces}):
            numbers = np.array([i for i, p in enumerate(pieces) if len(p) == length])
            data = np.frombuffer(b"".join(pieces[i] for i in numbers), np.uint8).reshape(len(numbers), length)
            codes = np.zeros(len(numbers), np.uint64)
            for i in range(length):
                codes = codes * _STEP + data[:, i] + np.uint64(1)
            order = codes.argsort()
            self.tables[length] = codes[order], numbers[order], data[order]
        self.longest = max(self.tables)

    def substrings(self, words: np.ndarray) -> dict[int, np.ndarray]:
        """Length -> array (words, starts) of piece numbers, ``self.n`` where a substring is no piece; lengths without any are left out."""
        size = words.shape[1]
        codes, found = np.zeros(words.shape, np.uint64), {}
        for length in range(1, min(self.longest, size) + 1):
            codes = codes[:, : size - length + 1] * _STEP + words[:, length - 1 :] + np.uint64(1)
            if length not in self.tables:
                continue
            table, numbers, data = self.tables[length]
            at = np.minimum(np.searchsorted(table, codes), len(table) - 1)
            row, start = np.nonzero(table[at] == codes)
            hit = at[row, start]
            same = (words[row[:, None], start[:, None] + np.arange(length)] == data[hit]).all(axis=1)
            if same.any():
                found[length] = np.full(codes.shape, self.n)
                found[length][row[same], start[same]] = numbers[hit[same]]
        return found


def by_length(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions in ``words``, byte array) of groups of equally long words."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        step = max(1, STEP // max(int(size), 16))
        for part in range(0, len(at), step):
            some = at[part : part + step]
            yield some, np.frombuffer(b"".join([words[i] for i in some]), np.uint8).reshape(len(some), size).astype(np.uint64)


def forward(found: dict[int, np.ndarray], probs: np.ndarray, size: int) -> np.ndarray:
    """alpha (words, size + 1, languages). ``probs`` (pieces + 1, languages), last row zero."""
    n = next(iter(found.values())).shape[0]
    alpha = np.zeros((n, size + 1, probs.shape[1]))
    alpha[:, 0] = 1.0
    of = {length: probs[ids] for length, ids in found.items()}
    for end in range(1, size + 1):
        for length, p in of.items():
            if length <= end:
                alpha[:, end] += alpha[:, end - length] * p[:, end - length]
    return alpha


def log_forward(found: dict[int, np.ndarray], logs: np.ndarray, size: int) -> np.ndarray:
    """Logarithms of alpha, for words of any length."""
    n = next(iter(found.values())).shape[0]
    alpha = np.full((n, size + 1, logs.shape[1]), -np.inf)
    alpha[:, 0] = 0.0
    for end in range(1, size + 1):
        terms = [alpha[:, end - length] + logs[ids[:, end - length]] for length, ids in found.items() if length <= end]
        alpha[:, end] = np.logaddexp.reduce(terms)
    return alpha


def log_long(word: bytes, pieces: Pieces, logs: np.ndarray, chunk: int = LONG) -> np.ndarray:
    """Log-probability of one word, whose bytes are worked on in chunks; only the last positions are kept."""
    last = deque([np.zeros(logs.shape[1])], maxlen=pieces.longest)
    for at in range(0, len(word), chunk):
        low = max(0, at - pieces.longest + 1)
        found = pieces.substrings(np.frombuffer(word[low : at + chunk], np.uint8).astype(np.uint64)[None])
        for end in range(at + 1, min(at + chunk, len(word)) + 1):
            terms = [last[-length] + logs[ids[0, end - length - low]] for length, ids in found.items() if length <= end - low]
            last.append(np.logaddexp.reduce(terms))
    return last[-1]


def word_scores(words: list[str], pieces: Pieces, probs: np.ndarray) -> np.ndarray:
    """Log-probability of each word in each language."""
    raw = [w.encode("utf-8", "surrogatepass") for w in words]
    with np.errstate(divide="ignore"):
        logs = np.log(probs)
    out = np.zeros((len(words), probs.shape[1]))
    short = [i for i, w in enumerate(raw) if len(w) <= LONG]
    for at, chars in by_length([raw[i] for i in short]):
        found, size = pieces.substrings(chars), chars.shape[1]
        rows = np.array(short)[at]
        if size <= SHORT:
            out[rows] = np.log(np.maximum(forward(found, probs, size)[:, -1], 1e-300))
        else:
            out[rows] = log_forward(found, logs, size)[:, -1]
    for i, w in enumerate(raw):
        if len(w) > LONG:
            out[i] = log_long(w, pieces, logs)
    return out


def _expected(words: list[bytes], counts: np.ndarray, pieces: Pieces, probs: np.ndarray | None) -> np.ndarray:
    """Expected piece counts of one language; without probabilities every occurrence of a piece counts."""
    total = np.zeros(pieces.n + 1)
    logs = None
    if probs is not None:
        with np.errstate(divide="ignore"):
            logs = np.log(probs)
    for at, chars in by_length(words):
        found, weight, size = pieces.substrings(chars), counts[at], chars.shape[1]
        if logs is None:
            for length, ids in found.items():
                total += np.bincount(ids.ravel(), np.repeat(weight * length / size, ids.shape[1]), pieces.n + 1)
            continue
        alpha = log_forward(found, logs[:, None], size)[:, :, 0]
        beta = np.full_like(alpha, -np.inf)
        beta[:, size] = 0.0
        for start in range(size - 1, -1, -1):
            terms = [logs[ids[:, start]] + beta[:, start + length] for length, ids in found.items() if start + length <= size]
            beta[:, start] = np.logaddexp.reduce(terms)
        for length, ids in found.items():
            flow = np.exp(alpha[:, : size - length + 1] + logs[ids] + beta[:, length:] - alpha[:, -1:]) * weight[:, None]
            total += np.bincount(ids.ravel(), flow.ravel(), pieces.n + 1)
    total[pieces.n] = 0
    return total


def smoothed(counts: np.ndarray, vocabulary: list[bytes]) -> np.ndarray:
    floor = np.array([0.05 if len(p) > 1 else 0.5 for p in vocabulary])
    p = counts + floor
    return np.append(p / p.sum(), 0.0)


def in_sample(doc_id: str, rows: int, wanted: int) -> Column:
    """About ``wanted`` of ``rows`` documents by hash; all of them if there are no more."""
    least = 1 << 20 if rows <= wanted else int(wanted / rows * (1 << 20))
    return F.pmod(F.xxhash64(F.col(doc_id), F.lit(7)), F.lit(1 << 20)) < least


def _quota(counts: list[int], wanted: int) -> float:
    """Documents of each language at most, so that ``wanted`` are drawn in all: rare languages keep all of theirs."""
    left = wanted
    for i, n in enumerate(sorted(counts)):
        if n * (len(counts) - i) >= left:
            return left / (len(counts) - i)
        left -= n
    return float(max(counts, default=0))


def fit(labelled: DataFrame, vocabulary: list[bytes], train_docs: int = 12_000, rounds: int = 2) -> tuple[list[str], np.ndarray]:
    """(languages in order, probabilities (pieces + 1, languages)) from columns doc_id, text, lang."""
    known = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # a row per language
    shares = [(lang, 1 << 20 if n <= quota else int(quota / n * (1 << 20))) for quota in [_quota(list(counts.values()), train_docs)] for lang, n in counts.items()]
    least = labelled.sparkSession.createDataFrame(shares, "lang string, least long")
    drawn = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(7)), F.lit(1 << 20)) < F.col("least")
    sample = known.join(F.broadcast(least), "lang").filter(drawn).select("lang", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                c = Counter()
                for t in texts:
                    c.update(WORD.findall(t.lower()))
                if c:
                    yield pd.DataFrame({"lang": lang, "word": list(c), "n": list(c.values())})

    words = written(sample.mapInPandas(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")))
    languages: list[str] = []
    probs: np.ndarray | None = None
    spark = labelled.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary)
    for _ in range(rounds + 1):
        model = spark.sparkContext.broadcast((languages, probs))

        def expect(batches: Iterator[pd.DataFrame], model=model) -> Iterator[pd.DataFrame]:
            pieces = Pieces(shared.value)
            known, p = model.value
            for batch in batches:
                for lang, own in batch.groupby("lang"):
                    raw = [w.encode("utf-8", "surrogatepass") for w in own["word"]]
                    total = _expected(raw, own["n"].to_numpy(float), pieces, None if p is None else p[:, known.index(lang)])
                    at = np.flatnonzero(total > 1e-6)
                    yield pd.DataFrame({"lang": lang, "piece": at, "n": total[at]})

        sums = words.mapInPandas(expect, "lang string, piece long, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
        languages = sorted(sums["lang"].unique())
        if not languages:
            return [], np.zeros((len(vocabulary) + 1, 0))
        columns = []
        for lang in languages:
            own, c = sums[sums["lang"] == lang], np.zeros(len(vocabulary))
            c[own["piece"]] = own["n"]
            columns.append(smoothed(c, vocabulary))
        probs = np.stack(columns, axis=1)
    return languages, probs


def identify(
    docs: DataFrame, languages: list[str], probs: np.ndarray, vocabulary: list[bytes], chunk: int = 1_000_000, votes: bool = False, text: str = "text"
) -> DataFrame:
    """``docs`` without the column ``text``, unless there are ``votes``, with lang_pred and score (the posterior under equal
    priors); with ``votes`` also the number of words that are likeliest in each language, in the order of ``languages``."""
    shared = docs.sparkSession.sparkContext.broadcast((languages, probs, vocabulary))
    where = docs.columns.index(text)

    def make():
        known, p, vocab = shared.value
        pieces, cache = Pieces(vocab), {}
        table = np.zeros((0, len(known)))

        def totals(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            nonlocal table
            lists = [[w for w in WORD.findall(t.lower())] for t in texts]
            new = set(chain.from_iterable(lists))
            new.difference_update(cache)
            if len(cache) + len(new) > CACHE:
                cache.clear()
                table, new = table[:0], set(chain.from_iterable(lists))
            fresh = list(new)
            if fresh:
                cache.update(zip(fresh, range(len(table), len(table) + len(fresh)), strict=True))
                table = np.concatenate([table, word_scores(fresh, pieces, p)])
            sizes = np.array([len(x) for x in lists])
            sums, cast = np.zeros((len(texts), len(known))), np.zeros((len(texts), len(known)), np.int64)
            if sizes.sum():
                at = np.fromiter(map(cache.__getitem__, chain.from_iterable(lists)), np.int64, sizes.sum())
                full = np.flatnonzero(sizes)
                starts = (np.cumsum(sizes) - sizes)[full]
                found = table[at]
                sums[full] = np.add.reduceat(found, starts, axis=0)
                if votes:
                    cells = np.repeat(np.arange(len(texts)), sizes) * len(known) + found.argmax(axis=1)
                    cast = np.bincount(cells, minlength=cast.size).reshape(cast.shape)
            return sums, sizes, cast

        def run(batch: pa.RecordBatch) -> list[pa.Array]:
            texts = [t or "" for t in batch.column(where).to_pylist()]
            sums, sizes, cast = np.zeros((len(texts), len(known))), np.zeros(len(texts), int), np.zeros((len(texts), len(known)), np.int64)
            start = 0
            while known and start < len(texts):
                end, chars = start, 0
                while end < len(texts) and (end == start or chars < chunk):
                    chars += len(texts[end])
                    end += 1
                if end == start + 1 and chars > chunk:  # one very long text, cut where no word goes on
                    body, at = texts[start], 0
                    while at < len(body):
                        cut = min(at + chunk, len(body))
                        while cut < len(body) and WORD.match(body[cut]):
                            cut += 1
                        s, n, c = totals([body[at:cut]])
                        sums[start] += s[0]
                        sizes[start] += n[0]
                        cast[start] += c[0]
                        at = cut
                else:
                    sums[start:end], sizes[start:end], cast[start:end] = totals(texts[start:end])
                start = end
            if known:
                best = sums.argmax(axis=1)
                posterior = 1 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
                letters = np.array([n > 0 and any(map(str.isalpha, t)) for n, t in zip(sizes, texts, strict=True)], bool)
                lang = [known[b] if some else "und" for b, some in zip(best, letters, strict=True)]
                score = np.where(letters, posterior, 0.0)
            else:
                lang, score = ["und"] * len(texts), np.zeros(len(texts))
            return [pa.array(lang, pa.string()), pa.array(score, pa.float64())] + [pa.array(list(cast), pa.list_(pa.int64()))] * votes

        return run

    return appended(docs, make, "lang_pred string, score double" + ", votes array<long>" * votes, drop=() if votes else (text,))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def learned(docs: DataFrame, train_docs: int = 12_000):
    vocabulary = vocabulary_of(docs.sparkSession)
    return (*fit(docs.filter(~held_out()).select("doc_id", "text", "lang"), vocabulary, train_docs), vocabulary)


def of_stated_language(docs: DataFrame, sure: float = 0.99, least: float = 0.1) -> DataFrame:
    """``docs`` without those that have no letter or are surely of another language than their ``lang`` says.

    Sure is a score of at least ``sure`` with less than a share of ``least`` of the words likeliest in the stated language,
    so a document that quotes a long passage of another language stays. Null ``lang``, and one that was never learned, say
    nothing. The model is fitted on all labelled ``docs``.
    """
    vocabulary = vocabulary_of(docs.sparkSession)
    with scratch():
        languages, probs = fit(docs.select("doc_id", "text", "lang"), vocabulary)
    # Columns go by number, so that their names can't clash with those added.
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    lang = F.col(f"c{docs.columns.index('lang')}")
    found = identify(plain, languages, probs, vocabulary, votes=True, text=f"c{docs.columns.index('text')}")
    words = F.aggregate("votes", F.lit(0).cast("long"), lambda a, v: a + v)
    stated = F.lit(None).cast("long")
    for i, name in enumerate(languages):
        stated = F.when(lang == name, F.get("votes", F.lit(i))).otherwise(stated)
    other = (lang != F.col("lang_pred")) & (F.col("score") >= sure) & (stated < least * words)
    kept = found.filter((F.col("lang_pred") != "und") & ~F.coalesce(other, F.lit(False)))
    return kept.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    with scratch():
        model = learned(docs)
    return identify(docs.select("doc_id", held_out().alias("held_out"), "text"), *model)
