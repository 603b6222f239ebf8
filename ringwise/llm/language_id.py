"""Language identification by segmentation-marginalised unigram models over a fixed public vocabulary.

A word is generated piece by piece; its probability under a language is the sum over *all* segmentations into
vocabulary pieces of the product of that language's piece probabilities.  The forward algorithm computes that sum
in one pass over the characters, so no single (best) segmentation has to be chosen.  Words are independent, so a
text's log-likelihood is the sum over its words, each scored once per worker and kept in a bounded cache.

Training is expectation maximisation: from equal piece probabilities, each round counts every piece's expected use
(forward-backward) over the words of all training rows per language inside the tasks, sums the counts by
(language, piece) on Spark, and re-normalises.  What reaches the driver is one row per (language, piece): bounded by
the vocabulary times the number of languages.

Characters outside the vocabulary are one-character pieces of a fixed small probability, equal for all languages.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ringwise.llm.arrow import chunks, mix

#: Longest vocabulary piece that is used, in characters (with the word-start mark).
MAX_PIECE = 8
#: Words kept per worker; the cache is emptied when it is full.
CACHE_WORDS = 300_000
#: Matrix cells of one forward step over a group of words of like length.
CELLS = 1 << 18
#: A longer run of letters is scored in stretches of so many characters.
MAX_WORD = 120
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))
_START = "▁"
_LETTER = re.compile(r"[^\W\d_]")


def vocabulary(model_file: str) -> list[str]:
    """Pieces of a public sentencepiece vocabulary, without control, byte and over-long ones, lower-cased, sorted."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    pieces = {sp.id_to_piece(i).lower() for i in range(sp.get_piece_size())
              if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
    return sorted(p for p in pieces if 0 < len(p) <= MAX_PIECE)


def has_letter(text: str | None) -> bool:
    if not text:
        return False
    return any(m[0].isalpha() for m in _LETTER.finditer(text))


def _code_hash(codes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return codes.astype(np.uint64) * weights


class Lattice:
    """All vocabulary pieces at all positions of a group of words, found by hashing every substring."""

    def __init__(self, pieces: list[str]):
        self.n = len(pieces)
        self.weights = mix(np.arange(1, MAX_PIECE + 1, dtype=np.uint64)) | np.uint64(1)
        keys = np.empty(self.n, np.uint64)
        for i, p in enumerate(pieces):
            c = np.frombuffer(p.encode("utf-32-le"), np.uint32)
            keys[i] = _code_hash(c + 1, self.weights[:len(c)]).sum(dtype=np.uint64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ids = keys[order], order.astype(np.int64)
        self.seen = np.zeros(1 << 20, bool)  # by the top 20 bits: most substrings are no piece
        self.seen[self.keys >> np.uint64(44)] = True

    def find(self, codes: np.ndarray) -> np.ndarray:
        """codes [words, length] (0 pads) -> piece index [words, start, piece length - 1], ``n`` if none."""
        w, length = codes.shape
        out = np.full((w, length, min(MAX_PIECE, length)), self.n, np.int64)
        for k in range(1, out.shape[2] + 1):
            h = np.zeros((w, length - k + 1), np.uint64)
            for j in range(k):
                h += _code_hash(codes[:, j:length - k + 1 + j] + 1, self.weights[j])
            row, col = np.nonzero(self.seen[h >> np.uint64(44)] & (codes[:, k - 1:] != 0))
            own = h[row, col]
            at = np.minimum(np.searchsorted(self.keys, own), self.n - 1)
            hit = self.keys[at] == own
            out[row[hit], col[hit], k - 1] = self.ids[at[hit]]
        return out


class Model:
    """Piece probabilities per language: ``probs`` [pieces + 1, languages]; the last row (no piece) is zero."""

    #: Probability of a character that is no piece of the vocabulary.
    UNKNOWN = 1e-7

    def __init__(self, pieces: list[str], langs: list[str], probs: np.ndarray, prior: np.ndarray):
        self.pieces, self.langs, self.prior = pieces, langs, prior
        self.probs = np.vstack([probs, np.zeros((1, probs.shape[1]))])
        self.lattice = Lattice(pieces)

    def groups(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Words of like length as padded code matrices: (indices into ``words``, codes)."""
        lengths = np.array([len(w) + 1 for w in words])
        order = np.argsort(lengths, kind="stable")
        a = 0
        while a < len(order):
            longest = int(lengths[order[a]])
            b = a + max(1, CELLS // (longest * MAX_PIECE))
            b = min(b, int(np.searchsorted(lengths[order], longest + longest // 8, side="right")), len(order))
            b = max(b, a + 1)
            at = order[a:b]
            width = int(lengths[at].max())
            text = "".join((_START + words[i]).ljust(width, "\0") for i in at)
            yield at, np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(at), width)
            a = b

    def terms(self, codes: np.ndarray, langs: slice) -> tuple[np.ndarray, np.ndarray]:
        """Piece and its probability for every start and length: [words, start, length - 1(, languages)]."""
        found = self.lattice.find(codes)
        p = self.probs[:, langs][found]
        p[:, :, 0][found[:, :, 0] == self.lattice.n] = self.UNKNOWN
        return found, p

    @staticmethod
    def forward(p: np.ndarray) -> np.ndarray:
        """Log of the sum over all segmentations of the first t characters, [t, words, languages].

        Sums of the last MAX_PIECE positions are kept relative to the newest one, so nothing underflows.
        """
        w, length, most, nl = p.shape
        logs = np.zeros((length + 1, w, nl))
        past = np.zeros((most, w, nl))  # past[k - 1]: sum at t - k, relative to t - 1
        past[0] = 1.0
        for t in range(1, length + 1):
            total = np.zeros((w, nl))
            for k in range(1, min(most, t) + 1):
                total += past[k - 1] * p[:, t - k, k - 1]
            logs[t] = logs[t - 1] + np.log(total)
            past[1:] = past[:-1] / total
            past[0] = 1.0
        return logs

    def score(self, words: list[str]) -> np.ndarray:
        """Log-probability of each word under each language, [words, languages]."""
        out = np.zeros((len(words), len(self.langs)))
        for at, codes in self.groups(words):
            logs = self.forward(self.terms(codes, slice(None))[1])
            out[at] = logs[(codes != 0).sum(axis=1), np.arange(len(at))]
        return out

    def expected(self, words: list[str], counts: np.ndarray, lang: int) -> np.ndarray:
        """Expected uses of every piece under one language, by forward-backward over all segmentations."""
        use = np.zeros(self.lattice.n + 1)
        for at, codes in self.groups(words):
            found, p = self.terms(codes, slice(lang, lang + 1))
            p = p[..., 0]
            logs = self.forward(p[..., None])[..., 0]
            ends = (codes != 0).sum(axis=1)
            w, length, most = p.shape
            # cut[t]: probability that a segmentation of the word has a boundary at t
            cut = np.zeros((length + 1, w))
            cut[ends, np.arange(w)] = 1.0
            gamma = np.zeros((w, length, most))
            for t in range(length - 1, -1, -1):
                for k in range(1, min(most, length - t) + 1):
                    gamma[:, t, k - 1] = np.where(
                        t + k <= ends, p[:, t, k - 1] * np.exp(np.minimum(logs[t] - logs[t + k], 600.0)), 0.0) * cut[t + k]
                cut[t] = np.where(ends == t, 1.0, gamma[:, t].sum(axis=1))
            gamma *= counts[at][:, None, None]
            use += np.bincount(found.ravel(), gamma.ravel(), self.lattice.n + 1)
        return use[:-1]


def _words(text: bytes) -> list[bytes]:
    """Runs of letters (ASCII) and of non-ASCII characters, A-Z lower-cased; a run of over MAX_WORD bytes counts as
    consecutive stretches of MAX_WORD characters."""
    words = text.translate(_FOLD).split()
    if max(map(len, words), default=0) <= MAX_WORD:
        return words
    out = []
    for w in words:
        s = w.decode("utf-8", "replace")
        out += [s[i:i + MAX_WORD].encode() for i in range(0, len(s), MAX_WORD)]
    return out


def _lower(words: list[bytes]) -> list[str]:
    return [w.decode("utf-8", "replace").lower() for w in words]


def train(docs: DataFrame, model_file: str, rounds: int = 1, smoothing: float = 0.5) -> Model:
    """Fit the model on ``docs(text, lang)``; rows with null lang or text teach nothing.

    Languages are the distinct values of lang, sorted.  Every training row counts (no sample).
    """
    pieces = vocabulary(model_file)
    docs = docs.where("lang is not null and text is not null")
    totals = {r["lang"]: r["n"] for r in docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(totals)
    prior = np.log(np.array([totals[x] for x in langs], float) / max(1, sum(totals.values()))) if langs else np.zeros(0)
    probs = np.full((len(pieces), len(langs)), 1.0 / len(pieces))
    for _ in range(rounds if langs else 0):
        model = Model(pieces, langs, probs, prior)

        def count(batches: Iterator[pa.RecordBatch], model=model) -> Iterator[pa.RecordBatch]:
            index = {x: i for i, x in enumerate(model.langs)}
            held: Counter = Counter()
            use = np.zeros((len(model.pieces), len(model.langs)))

            def flush():
                for lang in range(len(model.langs)):
                    own = [(w, n) for (x, w), n in held.items() if x == lang]
                    if own:
                        use[:, lang] += model.expected(_lower([w for w, _ in own]),
                                                       np.array([n for _, n in own], float), lang)
                held.clear()

            for batch in batches:
                for part, texts in chunks(batch):
                    for lang, text in zip(part.column("lang").to_pylist(), texts):
                        words = _words(text)
                        held.update(zip([index[lang]] * len(words), words))
                    if len(held) > CACHE_WORDS:
                        flush()
            if held:
                flush()
            at, lang = np.nonzero(use)
            yield pa.RecordBatch.from_arrays([pa.array(lang.astype(np.int32)), pa.array(at.astype(np.int32)),
                                              pa.array(use[at, lang])], names=["lang", "piece", "n"])

        counted = (docs.select("text", "lang").mapInArrow(count, "lang int, piece int, n double")
                   .groupBy("lang", "piece").agg(F.sum(F.round(F.col("n") * 1e6).cast("long")).alias("n")))
        table = counted.toArrow()
        use = np.full(probs.shape, smoothing)
        use[table.column("piece").to_numpy(), table.column("lang").to_numpy()] += table.column("n").to_numpy() / 1e6
        probs = use / use.sum(axis=0)
    return Model(pieces, langs, probs, prior)


def predict(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """``docs(text, ...)`` -> the columns ``keep``, ``lang_pred`` and ``score`` (posterior of that language).

    The whole text is scored.  Null text or text without a letter: ``und`` with score 0; so is every text when no
    language was learned.  Ties go to the first language in order.
    """
    schema = docs.select(*keep).schema
    out_schema = T.StructType([*schema.fields, T.StructField("lang_pred", T.StringType()),
                               T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[bytes, int] = {}
        table = np.zeros((CACHE_WORDS * 2, len(model.langs)))
        for batch in batches:
            langs, scores = [], []
            for part, texts in chunks(batch):
                split = [_words(t) for t in texts]
                new = {w for ws in split for w in ws if w not in cache}
                if len(cache) + len(new) > len(table):
                    cache.clear()
                    new = {w for ws in split for w in ws}
                    if len(new) > len(table):
                        table = np.zeros((len(new), len(model.langs)))
                new = list(new)
                first = len(cache)
                if new and model.langs:
                    table[first:first + len(new)] = model.score(_lower(new))
                cache.update(zip(new, range(first, first + len(new))))
                for text, ws in zip(texts, split):
                    if not model.langs or not has_letter(text.decode("utf-8", "replace")):
                        langs.append("und")
                        scores.append(0.0)
                        continue
                    total = model.prior + table[[cache[w] for w in ws]].sum(axis=0)
                    best = int(np.argmax(total))
                    langs.append(model.langs[best])
                    scores.append(float(1.0 / np.exp(total - total[best]).sum()))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f.name) for f in schema.fields), pa.array(langs, pa.string()),
                 pa.array(scores, pa.float64())], names=[*schema.names, "lang_pred", "score"])

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, out_schema)


def fold(doc_id: Column, folds: int = 3) -> Column:
    """Fold of a row: crc32 of the id as text, modulo ``folds``; null id: null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def identify(docs: DataFrame, model_file: str, keep: list[str] | None = None) -> DataFrame:
    """Learn from the rows of ``docs(doc_id, text, lang)`` outside fold 1 and predict every row.

    Returns ``doc_id, held_out, lang_pred, score`` (or the columns ``keep`` instead of the first two).  A null doc_id
    is not held out.  Repeated rows are answered each; other columns are ignored unless kept.
    """
    rows = docs.withColumn("held_out", F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False)))
    model = train(rows.where("not held_out").select("text", "lang"), model_file)
    return predict(rows, model, keep or ["doc_id", "held_out"])
