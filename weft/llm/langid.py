"""Language identification by segmentation-marginalised unigrams.

A fixed public vocabulary gives the pieces; for each language a probability of each piece is learned.  The likelihood of a
word is the sum over all its segmentations into pieces of the product of their probabilities (a forward pass over the
word's lattice; characters without a piece fall back to the vocabulary's byte pieces), that of a text the product over its
words.  The prediction is the language of highest likelihood, its score the posterior under equal priors.

Learning is expectation-maximisation over all labelled training text: words are counted per language first, so a pass
costs the distinct words only; each pass returns expected piece counts, at most vocabulary x languages numbers, which are
all the driver ever sees.

Words are maximal runs of letters with their combining marks, in lower case, of any length: words of like length are
computed together, and one of more than ``LONG`` characters alone and piece by piece of itself.

Defined results: ``und`` with score 0 for null text, text without letters, or if nothing was learned; ties go to the
language that sorts first; rows without language or doc_id are never learned from; more than ``LANGUAGES`` different
languages are refused, as the model is a table of pieces and languages; repeated rows count repeatedly; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.common import pin
from weft.llm.vocab import worker_store

LONG, LANGUAGES = 256, 500
PASSES = 2
SMOOTH = 0.05
SLICE = 4 << 20
#: Words less probable than this, in any language, are computed in logarithms.
TINY = 1e-250
REMEMBERED = 700_000
#: Numbers of one array: lattice nodes x languages, and remembered parts x languages.
CELLS, KNOWN = 2 << 20, 8 << 20
#: Characters of a long word whose lattice is held at once.
REACH = 1 << 14
_WORD = regex.compile(r"(?:\p{L}\p{M}*)+")


def pieces_of(path: str | None = None) -> list[str]:
    """The vocabulary's pieces in the order of their ids; byte pieces are ``<0x00>`` to ``<0xFF>``."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
    return [model.id_to_piece(i) for i in range(model.get_piece_size())]


class Lattices:
    """The segmentations of words as edges between character (or byte) boundaries."""

    def __init__(self, pieces: list[str]) -> None:
        self.id = {p: i for i, p in enumerate(pieces)}
        self.byte = [self.id[f"<0x{b:02X}>"] for b in range(256)]
        import ahocorasick

        self.finder = ahocorasick.Automaton()  # finds all pieces in a string; a hit is number and length
        for p, i in self.id.items():
            self.finder.add_word(p, i << 8 | len(p))
        self.finder.make_automaton()
        self.widest = max(map(len, pieces))

    def edges(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Rows (word, from, to, piece) ordered by (to, word), and the last node of each word."""
        strings = ["▁" + w for w in words]
        length = np.array([len(s) for s in strings], np.int64)
        joined = "\n".join(strings)
        strange = set(joined) - self.id.keys() - {"\n"}
        hits = np.array(list(self.finder.iter(joined)), np.int64).reshape(-1, 2)
        first = np.cumsum(length + 1) - length - 1
        word = np.searchsorted(first, hits[:, 0], "right") - 1
        to = hits[:, 0] + 1 - first[word]
        rows = np.stack((word, to - (hits[:, 1] & 255), to, hits[:, 1] >> 8))
        rows = rows[:, rows[1] >= 0]  # none crosses the line end, which is no piece
        if strange:
            rows, length = self._with_bytes(strings, strange, rows, length)
        return rows[:, np.lexsort((rows[0], rows[2]))], length

    def _with_bytes(self, strings: list[str], strange: set[str], rows: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters without a piece get a node for each byte, and edges from byte to byte."""
        more, length = [rows], length.copy()
        keep = np.ones(rows.shape[1], bool)
        for k, s in enumerate(strings):
            if strange.isdisjoint(s):
                continue
            raw = [c.encode("utf-8", "surrogatepass") if c in strange else b"." for c in s]
            node = np.cumsum([0] + [len(r) for r in raw])
            own = rows[0] == k
            keep &= ~own
            x = rows[:, own].copy()
            x[1], x[2] = node[x[1]], node[x[2]]
            steps = [(k, node[i] + j, node[i] + j + 1, self.byte[b]) for i, c in enumerate(s) if c in strange for j, b in enumerate(raw[i])]
            more += [x, np.array(steps, np.int64).T]
            length[k] = node[-1]
        more[0] = rows[:, keep]
        return np.concatenate(more, axis=1), length

    def forward(self, e: np.ndarray, last: np.ndarray, p: np.ndarray) -> np.ndarray:
        """[word, node, column]: the probability of reaching each node; ``p`` is [piece, column] or [edge, column]."""
        alpha = np.zeros((len(last), int(last.max()) + 1, p.shape[1]))
        alpha[:, 0] = 1
        for lo, hi in self._levels(e[2]):
            w, flow = e[0, lo:hi], None
            flow = alpha[w, e[1, lo:hi]] * p[lo:hi]
            first = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1])))
            alpha[w[first], e[2, lo]] = np.add.reduceat(flow, first)
        return alpha

    def backward(self, e: np.ndarray, last: np.ndarray, p: np.ndarray) -> np.ndarray:
        beta = np.zeros((len(last), int(last.max()) + 1, p.shape[1]))
        beta[np.arange(len(last)), last] = 1
        order = np.lexsort((e[0], -e[1]))
        e, p = e[:, order], p[order]
        for lo, hi in self._levels(e[1]):
            w = e[0, lo:hi]
            flow = beta[w, e[2, lo:hi]] * p[lo:hi]
            first = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1])))
            beta[w[first], e[1, lo]] += np.add.reduceat(flow, first)
        return beta

    def log_pass(self, e: np.ndarray, last: np.ndarray, log_p: np.ndarray, back: bool = False) -> np.ndarray:
        """The logarithm of :meth:`forward` or :meth:`backward`, for words whose probability a float can't hold."""
        a, b = (2, 1) if back else (1, 2)
        out = np.full((len(last), int(last.max()) + 1, log_p.shape[1]), -np.inf)
        out[np.arange(len(last)), last if back else 0] = 0
        order = np.lexsort((e[0], -e[1] if back else e[2]))
        e, log_p = e[:, order], log_p[order]
        for lo, hi in self._levels(e[b]):
            w = e[0, lo:hi]
            flow = out[w, e[a, lo:hi]] + log_p[lo:hi]
            first = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1])))
            out[w[first], e[b, lo]] = np.logaddexp.reduceat(flow, first)
        return out

    @staticmethod
    def _levels(nodes: np.ndarray) -> list[tuple[int, int]]:
        cuts = [0, *(np.flatnonzero(np.diff(nodes)) + 1).tolist(), len(nodes)]
        return list(zip(cuts[:-1], cuts[1:], strict=True)) if len(nodes) else []

    @staticmethod
    def _batches(words: list[str], columns: int) -> Iterator[np.ndarray]:
        """Places of the words, those of like length together; a long word comes alone."""
        length = np.array([len(w) for w in words], np.int64)
        order = np.argsort(length, kind="stable")
        at = 0
        while at < len(order):
            # as many as have room with the longest of them, which is found from a first guess
            n = max(1, min(20_000, CELLS // ((int(length[order[at]]) + 2) * columns)))
            while n > 1 and n * (int(length[order[min(at + n, len(order)) - 1]]) + 2) * columns > CELLS:
                n //= 2
            if length[order[at]] > LONG:
                n = 1
            else:
                n = min(n, int(np.searchsorted(length[order], LONG, "right")) - at)
            yield order[at : at + n]
            at += n

    def _reaches(self, word: str, back: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, dict[int, list[int]]]]:
        """A long word's edges reach by reach: (first node, from, to, piece, strange), ordered by ``to``.  A character
        without a piece is one edge of piece -1; ``strange`` has its bytes' pieces by its place."""
        s = "▁" + word
        for lo in sorted(range(0, len(s), REACH), reverse=back):
            hi = min(lo + REACH, len(s))
            start = max(0, lo - self.widest)
            hits = np.array(list(self.finder.iter(s[start:hi])), np.int64).reshape(-1, 2)
            to = hits[:, 0] + 1 + start
            from_, piece = to - (hits[:, 1] & 255), hits[:, 1] >> 8
            strange = {i: [self.byte[b] for b in s[i].encode("utf-8", "surrogatepass")] for i in range(lo, hi) if s[i] not in self.id}
            own = np.array(list(strange), np.int64)
            from_, to, piece = np.concatenate((from_, own)), np.concatenate((to, own + 1)), np.concatenate((piece, np.full(len(own), -1)))
            keep = np.flatnonzero(to > lo)
            keep = keep[np.argsort(to[keep], kind="stable")]
            yield lo, from_[keep], to[keep], piece[keep], strange

    @staticmethod
    def _edge_logs(log_p: np.ndarray, from_: np.ndarray, piece: np.ndarray, strange: dict[int, list[int]]) -> np.ndarray:
        out = log_p[piece]
        for i in np.flatnonzero(piece < 0).tolist():
            out[i] = log_p[strange[int(from_[i])]].sum(axis=0)
        return out

    def long_likelihood(self, word: str, log_p: np.ndarray) -> np.ndarray:
        """[language]: the logarithm of a long word's probability; the last ``widest`` nodes are all that is held."""
        tail = np.full((self.widest, log_p.shape[1]), -np.inf)
        tail[-1] = 0
        for lo, from_, to, piece, strange in self._reaches(word):
            flow = self._edge_logs(log_p, from_, piece, strange)
            alpha = np.concatenate((tail, np.full((int(to[-1]) - lo, log_p.shape[1]), -np.inf)))
            shift = self.widest - 1 - lo  # node -> row
            for a, z in self._levels(to):
                alpha[to[a] + shift] = np.logaddexp.reduce(alpha[from_[a:z] + shift] + flow[a:z], axis=0)
            tail = alpha[-self.widest :]
        return tail[-1]

    def long_expected(self, word: str, weight: float, language: int, log_p: np.ndarray, out: np.ndarray) -> None:
        """Adds a long word's expected uses to ``out``; holds two numbers for each character."""
        n = len(word) + 1
        alpha, beta = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
        alpha[0] = beta[n] = 0
        log_p = log_p[:, language : language + 1]
        for _, from_, to, piece, strange in self._reaches(word):
            flow = self._edge_logs(log_p, from_, piece, strange)[:, 0]
            for a, z in self._levels(to):
                alpha[to[a]] = np.logaddexp.reduce(alpha[from_[a:z]] + flow[a:z])
        for _, from_, to, piece, strange in self._reaches(word, back=True):
            flow = self._edge_logs(log_p, from_, piece, strange)[:, 0]
            for a, z in reversed(self._levels(to)):
                beta[from_[a:z]] = np.logaddexp(beta[from_[a:z]], beta[to[a]] + flow[a:z])
            use = weight * np.exp(alpha[from_] + flow + beta[to] - alpha[n])
            np.add.at(out, (piece[piece >= 0], language), use[piece >= 0])
            for i in np.flatnonzero(piece < 0).tolist():
                np.add.at(out, (strange[int(from_[i])], language), use[i])

    def log_likelihoods(self, words: list[str], p: np.ndarray) -> np.ndarray:
        """[word, language]."""
        out = np.zeros((len(words), p.shape[1]))
        for places in self._batches(words, p.shape[1]):
            some = [words[i] for i in places.tolist()]
            if len(some[0]) > LONG:
                out[places] = self.long_likelihood(some[0], np.log(p))
                continue
            e, last = self.edges(some)
            z = self.forward(e, last, p[e[3]])[np.arange(len(last)), last]
            low = np.flatnonzero((z < TINY).any(axis=1))
            z = np.log(np.maximum(z, TINY))
            if len(low):
                e, last = self.edges([some[k] for k in low])
                z[low] = self.log_pass(e, last, np.log(p[e[3]]))[np.arange(len(last)), last]
            out[places] = z
        return out

    def expected(self, words: list[str], weights: np.ndarray, language: np.ndarray, p: np.ndarray) -> np.ndarray:
        """[piece, language]: expected uses of each piece in the weighted words, each under its own language."""
        out = np.zeros(p.shape)
        for places in self._batches(words, 4):
            some, lang, n = [words[i] for i in places.tolist()], language[places], weights[places]
            if len(some[0]) > LONG:
                self.long_expected(some[0], float(n[0]), int(lang[0]), np.log(p), out)
                continue
            e, last = self.edges(some)
            own = p[e[3], lang[e[0]]][:, None]
            alpha, beta = self.forward(e, last, own)[:, :, 0], self.backward(e, last, own)[:, :, 0]
            z = alpha[np.arange(len(last)), last]
            low = np.flatnonzero(z < TINY)
            share = np.where(z < TINY, 0, n / np.maximum(z, TINY))
            use = alpha[e[0], e[1]] * own[:, 0] * beta[e[0], e[2]] * share[e[0]]
            out += np.bincount(e[3] * p.shape[1] + lang[e[0]], use, minlength=p.size).reshape(p.shape)
            if len(low):
                e, last = self.edges([some[k] for k in low])
                lang, n = lang[low], n[low]
                own = np.log(p[e[3], lang[e[0]]])[:, None]
                alpha, beta = self.log_pass(e, last, own)[:, :, 0], self.log_pass(e, last, own, back=True)[:, :, 0]
                z = alpha[np.arange(len(last)), last]
                use = np.exp(alpha[e[0], e[1]] + own[:, 0] + beta[e[0], e[2]] - z[e[0]]) * n[e[0]]
                np.add.at(out, (e[3], lang[e[0]]), use)
        return out


def words_in(part: str) -> list[str]:
    return [part] if part.isalpha() else _WORD.findall(part)


def _parts(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, list[str]]]:
    """Slices of texts: first and last row, each part's number, where each text's parts begin, the distinct parts."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(sizes // SLICE)) + 1).tolist(), len(texts)]
    for a, z in zip(cuts[:-1], cuts[1:], strict=True):
        split = pc.ascii_split_whitespace(pc.utf8_lower(texts.slice(a, z - a)))
        coded = pc.ascii_trim(split.flatten(), characters=".,!?;:()[]\"'").dictionary_encode()
        offsets = split.offsets.to_numpy(zero_copy_only=False)
        yield a, z, coded.indices.to_numpy(zero_copy_only=False), offsets - offsets[0], coded.dictionary.to_pylist()


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n) over ``docs`` (text, lang)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(counts: dict[str, Counter]) -> pa.RecordBatch:
            rows = [(lang, w, n) for lang, c in counts.items() for w, n in c.items()]
            cols = list(zip(*rows, strict=True)) or [[], [], []]
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64())], ["lang", "word", "n"])

        counts: dict[str, Counter] = defaultdict(Counter)
        for b in batches:
            langs = b.column("lang").to_pylist()
            for a, z, codes, offsets, distinct in _parts(b.column("text")):
                split = [words_in(p) for p in distinct]
                names = sorted(set(langs[a:z]))
                number = np.repeat([names.index(x) for x in langs[a:z]], np.diff(offsets))
                for k, name in enumerate(names):
                    n = np.bincount(codes[number == k], minlength=len(distinct))
                    c = counts[name]
                    for i in np.flatnonzero(n).tolist():
                        for w in split[i]:
                            c[w] += int(n[i])
                if sum(map(len, counts.values())) > REMEMBERED:
                    yield out(counts)
                    counts = defaultdict(Counter)
        yield out(counts)

    return docs.select("text", "lang").mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, pieces: list[str], passes: int = PASSES) -> tuple[list[str], np.ndarray]:
    """The languages in order, and [piece, language] probabilities, from ``docs`` (text, lang) without null languages."""
    spark = docs.sparkSession
    counts = pin(word_counts(docs))
    langs = sorted(r.lang for r in counts.select("lang").distinct().limit(LANGUAGES + 1).collect())
    if len(langs) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} different languages")
    p = np.full((len(pieces), len(langs)), 1 / len(pieces))
    for _ in range(passes if langs else 0):
        shared = spark.sparkContext.broadcast((pieces, p))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            names, probability = shared.value
            lattices, total = Lattices(names), np.zeros(probability.shape)
            for b in batches:
                for lo in range(0, len(b), 100_000):
                    x = b.iloc[lo : lo + 100_000]
                    total += lattices.expected(x["word"].tolist(), x["n"].to_numpy(float), x["l"].to_numpy(np.int64), probability)
            i, j = np.nonzero(total)
            yield pd.DataFrame({"piece": i, "l": j, "uses": total[i, j]})

        numbered = F.array_position(F.lit(langs), F.col("lang")) - 1
        uses = counts.select("word", "n", numbered.alias("l")).mapInPandas(run, "piece long, l long, uses double")
        got = uses.groupBy("piece", "l").agg(F.sum("uses").alias("uses")).toPandas()  # vocabulary x languages at most
        p = np.full(p.shape, SMOOTH)
        p[got["piece"].to_numpy(np.int64), got["l"].to_numpy(np.int64)] += got["uses"].to_numpy(float).round(6)
        p /= p.sum(axis=0)
    return langs, p


def predict(docs: DataFrame, keep: list[str], langs: list[str], p: np.ndarray, pieces: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` with lang_pred and score of the whole text."""
    shared = docs.sparkSession.sparkContext.broadcast((langs, p, pieces))
    tag = hash((p.tobytes(), tuple(langs)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema) + ", lang_pred string, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, probability, vocabulary = shared.value
        store = worker_store()
        if store.get("model") != tag:
            store |= {"model": tag, "lattices": Lattices(vocabulary), "place": {}, "scores": np.zeros((1 << 12, len(names) + 1))}
        for b in batches:
            labels, scores = [], []
            for a, z, codes, offsets, distinct in _parts(b.column("_text")):
                if not names:
                    labels += ["und"] * (z - a)
                    scores += [0.0] * (z - a)
                    continue
                if len(store["place"]) > min(REMEMBERED, KNOWN // (len(names) + 1)):
                    store["place"] = {}
                place = store["place"]
                new = [d for d in distinct if d not in place]
                split = [words_in(d) for d in new]
                words = {w: i for i, w in enumerate(dict.fromkeys(w for ws in split for w in ws))}
                of_word = store["lattices"].log_likelihoods(list(words), probability)
                rows = np.zeros((len(new), len(names) + 1))  # the last column counts words
                owner = np.repeat(np.arange(len(new)), [len(ws) for ws in split])
                which = np.array([words[w] for ws in split for w in ws], np.int64)
                for k in range(len(names)):
                    rows[:, k] = np.bincount(owner, of_word[which, k], minlength=len(new)) if len(which) else 0
                rows[:, -1] = np.bincount(owner, minlength=len(new))
                have = len(place)
                place.update(zip(new, range(have, have + len(new)), strict=True))
                if len(place) > len(store["scores"]):
                    store["scores"] = np.concatenate((store["scores"], np.zeros((max(len(place) - len(store["scores"]), len(store["scores"])), len(names) + 1))))
                known = store["scores"]
                known[have : len(place)] = rows
                each = known[np.array([place[d] for d in distinct], np.int64)] if distinct else rows
                sums = np.zeros((z - a, len(names) + 1))
                doc = np.repeat(np.arange(z - a), np.diff(offsets))
                for k in range(len(names) + 1):
                    sums[:, k] = np.bincount(doc, each[codes, k], minlength=z - a) if len(codes) else 0
                total = sums[:, :-1]
                best = total.argmax(axis=1)
                share = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
                some = sums[:, -1] > 0
                labels += [names[i] if s else "und" for i, s in zip(best, some, strict=True)]
                scores += np.where(some, share, 0.0).tolist()
            cols = [b.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(labels, pa.string()), pa.array(scores, pa.float64())], [*keep, "lang_pred", "score"])

    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def op3(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    pieces = pieces_of(vocabulary)
    train = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    langs, p = learn(train, pieces)
    out = predict(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), ["doc_id", "held_out"], langs, p, pieces)
    return out.select("doc_id", "held_out", "lang_pred", "score")
