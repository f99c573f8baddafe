"""Toxicity by Levenshtein automata over a lexicon trie, with context-window scores.

The lexicon is learned: words whose share among toxic training documents is far above their share among clean ones. All
its words stand in one trie; a word's automaton is walked along the trie, a state being the place in the word and the edits
left, and a branch ends where none are left. Each distinct word of a chunk is walked once and kept.
Words are runs of letters, digits and in-word signs, so 'id1ot' and 'st*pid' meet the automaton whole; where a letter run
of such a word is an entry, or the whole is near none, its letter runs count. A swap of neighbouring letters is one edit.
Entries of four letters take one substitution or swap, shorter ones none.

A hit is quoted if a quotation mark or a word of mention stands within ``window`` characters; quoted and plain hits, exact
and misspelled ones, weigh apart in a logistic regression over eight features. It is fitted on at most about
``train_docs`` labelled documents, chosen by hash among those that are not held out; every text is scored.

Defined results: null and empty texts score as texts without hits; ties in the lexicon go by code point; repeated rows
give repeated results; several labels of a document each count; with nothing to learn from every score is 0;
``held_out`` is false for a null doc_id; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import appended, read, scratch, small, written
from .language_id import WORD, in_sample

QUOTES = "\"'«»“”„‘’`"
MENTION = re.compile(r"\b(?:word|words|term|terms|said|says|called|quote|quoted|mot|palabra|wort)\b", re.I)
#: Letters and digits with signs among them; one that stands for a letter may also come first.
TOKEN = re.compile(r"[@$]?[^\W_]+(?:[@$*!#+|_.'’-]+[^\W_]+)*")
FEATURES = ("exact", "exact_max", "fuzzy", "fuzzy_max", "quoted", "distinct", "density", "any")


class Trie:
    """Lexicon entries with weights; ``near`` finds the entry of the largest weight within the edit bound of a word.

    With ``swaps`` a swap of neighbouring letters is one edit, and entries of four letters are within one substitution or swap.
    """

    def __init__(self, lexicon: dict[str, float], edits: int = 1, least: int = 5, swaps: bool = False) -> None:
        self.exact, self.edits, self.least, self.swaps = lexicon, edits, least, swaps
        self.short: dict[str, str] = {}
        self.root: dict = {}
        self.longest = max(map(len, lexicon), default=0)
        #: By length, how entries begin and end: one edit leaves the first part of an entry or the last one as it is.
        self.heads: dict[int, set[str]] = {}
        self.tails: dict[int, set[str]] = {}
        for word in lexicon:
            if len(word) >= least:
                cut = (len(word) - 1) // 2
                self.heads.setdefault(len(word), set()).add(word[:cut])
                self.tails.setdefault(len(word), set()).add(word[cut + 1 :])
                node = self.root
                for c in word:
                    node = node.setdefault(c, {})
                node[""] = word
            elif swaps and edits and len(word) == 4:
                for form in self._forms(word):
                    if form not in self.short or lexicon[word] > lexicon[self.short[form]]:
                        self.short[form] = word

    @staticmethod
    def _forms(word: str) -> list[str]:
        """Forms that a word shares with those that differ from it in one letter, and its swaps."""
        swapped = [word[:i] + word[i + 1] + word[i] + word[i + 2 :] for i in range(len(word) - 1)]
        return [word[:i] + "\0" + word[i + 1 :] for i in range(len(word))] + swapped

    def near(self, word: str) -> tuple[float, bool] | None:
        """(weight, whether exact), or None. Of several entries in reach it is the one with the largest weight."""
        if word in self.exact:
            return self.exact[word], True
        found: set[str] = set()
        if self.short and len(word) == 4:
            found.update(self.short[f] for f in (word, *self._forms(word)[:4]) if f in self.short)
        if self.least <= len(word) <= self.longest + self.edits and self._may(word):
            self._walk(word, 0, self.root, self.edits, found)
        return (max(self.exact[w] for w in found), False) if found else None

    def _may(self, word: str) -> bool:
        """Whether an entry of a length in reach begins or ends like the word, so that the automaton need run."""
        if self.edits != 1:
            return True
        for size in range(len(word) - 1, len(word) + 2):
            cut = (size - 1) // 2
            if size in self.heads and (word[:cut] in self.heads[size] or word[cut + 1 - size :] in self.tails[size]):
                return True
        return False

    def _walk(self, word: str, at: int, node: dict, left: int, found: set[str]) -> None:
        """Intersection of the word's automaton with the trie: all entries that both accept."""
        while not left and at < len(word):
            node = node.get(word[at])
            if node is None:
                return
            at += 1
        if at == len(word) and "" in node:
            found.add(node[""])
        if at < len(word) and word[at] in node:
            self._walk(word, at + 1, node[word[at]], left, found)
        if not left:
            return
        # With the last edit, a move is worth a call only if the letter after it goes on.
        now, after = word[at : at + 1], word[at + 1 : at + 2]
        if self.swaps and after and after in node and now in node[after]:
            self._walk(word, at + 2, node[after][now], left - 1, found)
        if now and (left > 1 or after in node):
            self._walk(word, at + 1, node, left - 1, found)
        for c, child in node.items():
            if c:
                if left > 1 or now in child:
                    self._walk(word, at, child, left - 1, found)
                if now and (left > 1 or after in child):
                    self._walk(word, at + 1, child, left - 1, found)


def _found(token: str, trie: Trie) -> list[tuple[int, int, str, tuple[float, bool]]]:
    """(start, end, word, (weight, whether exact)) of the hits in a token."""
    if token.isalpha():
        hit = trie.near(token)
        return [(0, len(token), token, hit)] if hit else []
    runs = [(m.start(), m.end(), m[0], trie.near(m[0])) for m in WORD.finditer(token)]
    runs = [r for r in runs if r[3]]
    if runs and any(r[3][1] for r in runs) or not any(map(str.isalpha, token)):
        return runs
    hit = trie.near(token)
    return [(0, len(token), token, hit)] if hit else runs


def features(text: str, trie: Trie, cache: dict, window: int = 30) -> tuple[float, ...]:
    low = text.lower()
    known = set(TOKEN.findall(low))
    for w in known.difference(cache):
        cache[w] = _found(w, trie)
    hits = {w: cache[w] for w in known if cache[w]}
    if not hits:
        return (0.0,) * len(FEATURES)
    exact, fuzzy, quoted, e_max, f_max, n = 0.0, 0.0, 0.0, 0.0, 0.0, 0
    for m in TOKEN.finditer(low):
        for start, end, _, hit in hits.get(m[0], ()):
            start, end = m.start() + start, m.start() + end
            n += 1
            around = low[max(0, start - window) : end + window]
            tight = low[max(0, start - 2) : start] + low[end : end + 2]
            if any(c in QUOTES for c in tight) or MENTION.search(around):
                quoted += hit[0]
            elif hit[1]:
                exact, e_max = exact + hit[0], max(e_max, hit[0])
            else:
                fuzzy, f_max = fuzzy + hit[0], max(f_max, hit[0])
    distinct = {w for found in hits.values() for _, _, w, _ in found}
    # At least one, also where a hit has no letter run of its own.
    words = max(1, len(WORD.findall(low)))
    return (math.log1p(exact), e_max, math.log1p(fuzzy), f_max, math.log1p(quoted), math.log1p(len(distinct)), 100 * n / words, 1.0)


def lexicon(sample: DataFrame, least_docs: int = 4, least_odds: float = 2.0) -> dict[str, float]:
    """Word -> log odds for all words that mark toxic documents, by evidence alone, from rows of (text, toxic)."""
    totals = sample.agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n")).first()
    toxic, clean = totals["t"] or 0, (totals["n"] or 0) - (totals["t"] or 0)

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in range(0, len(batch), 500):
                rows = [(w, y) for t, y in zip(batch["text"][part : part + 500], batch["toxic"][part : part + 500], strict=True) for w in set(WORD.findall(t.lower()))]
                yield pd.DataFrame(rows, columns=["word", "toxic"]).groupby("word", as_index=False).agg(t=("toxic", "sum"), n=("toxic", "size"))

    counts = sample.mapInPandas(words, "word string, t long, n long").groupBy("word").agg(F.sum("t").alias("t"), F.sum("n").alias("n"))
    odds = F.log((F.col("t") + 0.1) / (toxic + 1)) - F.log((F.col("n") - F.col("t") + 0.1) / (clean + 1))
    marked = counts.filter(F.col("t") >= least_docs).withColumn("odds", odds).filter(F.col("odds") >= least_odds)
    # Words of the bounded sample.
    return {r["word"]: r["odds"] for r in marked.orderBy("word").collect()}


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights with the intercept last, by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w, ridge = np.zeros(x.shape[1]), np.diag([l2] * (x.shape[1] - 1) + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T * (p * (1 - p) + 1e-9) @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += step
        if abs(step).max() < 1e-8:
            break
    return w


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = 20_000, edits: int = 1):
    """(trie, weights) from labelled documents that are not held out."""
    known = labels.select("doc_id", F.col("toxic").cast("long").alias("toxic")).filter(~held_out() & F.col("toxic").isNotNull())
    n = known.count()
    ids = known.filter(in_sample("doc_id", n, train_docs))
    sample = written(docs.select("doc_id", "text").join(small(ids, min(n, 2 * train_docs)), "doc_id").select(F.coalesce("text", F.lit("")).alias("text"), "toxic"))
    terms = lexicon(sample)
    trie = Trie(terms, edits, swaps=True)
    shared = docs.sparkSession.sparkContext.broadcast(trie)

    def described(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict = {}
        for batch in batches:
            yield pd.DataFrame([(y, *features(t, shared.value, cache)) for t, y in zip(batch["text"], batch["toxic"], strict=True)], columns=["y", *FEATURES])

    # At most about train_docs rows of nine numbers.
    table = sample.mapInPandas(described, "y long, " + ", ".join(f"{f} double" for f in FEATURES)).toPandas()
    if not len(table) or table["y"].nunique() < 2:
        return trie, None
    return trie, logistic(table[list(FEATURES)].to_numpy(float), table["y"].to_numpy(float))


def score(docs: DataFrame, trie: Trie, weights: np.ndarray | None, cache_words: int = 400_000) -> DataFrame:
    """doc_id, score."""
    shared = docs.sparkSession.sparkContext.broadcast((trie, weights))

    def make():
        own, w = shared.value
        cache: dict = {}

        def run(batch: pa.RecordBatch) -> list[pa.Array]:
            rows = []
            for t in batch.column("text").to_pylist():
                if len(cache) > cache_words:
                    cache.clear()
                rows.append(features(t or "", own, cache))
            x = np.array(rows, float).reshape(len(rows), len(FEATURES))
            return [pa.array(np.zeros(len(x)) if w is None else 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30))))]

        return run

    return appended(docs.select("doc_id", "text"), make, "score double", drop=("text",))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    with scratch():
        model = fit(docs, read(spark, sf_dir, "labels"))
    scored = score(docs, *model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
