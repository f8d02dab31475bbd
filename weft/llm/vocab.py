"""Word-piece ids of whole columns of text, equal to the tokenizer's own but with words looked up once.

The vocabulary drops white space and cuts at it, so a text's ids are those of its blank-separated parts in order.  Arrow
splits a column into parts and numbers the distinct ones; only parts that this worker has not met go to the tokenizer.
"""

from __future__ import annotations

import os
import sys
import types

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Parts that a worker remembers; it then starts afresh.
REMEMBERED = 300_000
#: Parts that are given to the tokenizer together.
LEARNED = 10_000


def worker_store() -> dict:
    """A dictionary that lives as long as the Python worker, across tasks."""
    return sys.modules.setdefault("_weft_worker", types.ModuleType("_weft_worker")).__dict__


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Vocabulary:
    """Ids of parts.  ``source`` is the tokenizer's JSON text."""

    def __init__(self, source: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(source)
        known = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(known.values()) + 1, bool)
        self.ends[[i for t, i in known.items() if t.endswith("</w>")]] = True
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.mark = self.special[-1]
        self.mark_id = self.tokenizer.token_to_id(self.mark)
        self._forget()

    def _forget(self) -> None:
        """Parts are numbered; their ids lie one after another in ``flat``, from ``first`` on, ``length`` of them each."""
        self.place = {"": 0}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.first, self.length = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.used = 0

    @classmethod
    def of(cls, source: str) -> Vocabulary:
        store = worker_store()
        if store.get("source") != source:
            store |= {"source": source, "vocabulary": cls(source)}
        return store["vocabulary"]

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _add(self, parts: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        """New parts, all different, with their ids."""
        n, end = len(self.place), self.used + len(ids)
        while end > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        while n + len(parts) > len(self.first):
            self.first, self.length = (np.concatenate((x, np.zeros_like(x))) for x in (self.first, self.length))
        self.flat[self.used : end] = ids
        self.first[n : n + len(parts)] = self.used + np.cumsum(lengths) - lengths
        self.length[n : n + len(parts)] = lengths
        self.place.update(zip(parts, range(n, n + len(parts)), strict=True))
        self.used = end

    def _gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of parts one after another, and where each part's end."""
        of = self.length[numbers]
        ends = np.cumsum(of)
        return self.flat[np.repeat(self.first[numbers] - (ends - of), of) + np.arange(ends[-1] if len(ends) else 0)], ends

    def _learn(self, parts: list[str]) -> None:
        """Ids of parts that are not known; none contains a special token."""
        plain, odd, ended = {}, [], []
        place = self.place
        for p in parts:
            word = p.rstrip(".,!?;:")
            if not word.isalpha():
                odd.append(p)
                continue
            if word not in place:
                plain[word] = None
            if len(word) < len(p):
                ended.append((p, word, p[len(word) :]))
        plain = list(plain)
        if plain:
            ids = self._encode(" ".join(plain))
            cuts = np.flatnonzero(self.ends[ids]) + 1  # a word is one run of pieces, and its last piece is marked
            if len(cuts) == len(plain):
                self._add(plain, ids, np.diff(cuts, prepend=0))
            else:
                odd += plain
        odd = list(dict.fromkeys([*odd, *(t for *_, t in ended if t not in place)]))
        if odd:
            ids = self._encode(self.mark.join(odd))
            at = np.flatnonzero(ids == self.mark_id)
            self._add(odd, ids[ids != self.mark_id], np.diff(np.concatenate(([-1], at, [len(ids)]))) - 1)
        if ended:
            both = np.array([place[x] for _, word, tail in ended for x in (word, tail)], np.int64)
            ids, _ = self._gather(both)
            self._add([p for p, *_ in ended], ids, self.length[both].reshape(-1, 2).sum(axis=1))

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and where each text's begin (one entry more than texts)."""
        texts = pc.fill_null(texts.cast(pa.string()), "")  # splitting slices of large_string is broken in Arrow
        low = pc.ascii_lower(texts)
        split = pc.ascii_split_whitespace(low)
        coded = split.flatten().dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        distinct = coded.dictionary.to_pylist()
        if len(self.place) > REMEMBERED:
            self._forget()
        place = self.place
        special = {p for p in distinct if "<|" in p and any(s in p for s in self.special)}
        new = [p for p in distinct if p not in place and p not in special]
        for i in range(0, len(new), LEARNED):  # the tokenizer holds some hundred bytes for each id at once
            self._learn([p for p in new[i : i + LEARNED] if p not in place])
        numbers = np.array([place[p] for p in distinct] if not special else [0 if p in special else place[p] for p in distinct], np.int64)
        out, ends = self._gather(numbers[codes])
        bounds = np.concatenate(([0], ends))[split.offsets.to_numpy(zero_copy_only=False) - split.offsets[0].as_py()]
        if special:  # the tokenizer finds these before it lowers case: such texts as a whole
            odd = {i for i, t in enumerate(low.to_pylist()) if any(s in t for s in self.special)}
            pieces = [self._encode(texts[i].as_py()) if i in odd else out[bounds[i] : bounds[i + 1]] for i in range(len(texts))]
            out, bounds = np.concatenate(pieces), np.concatenate(([0], np.cumsum([len(x) for x in pieces])))
        return out, bounds
