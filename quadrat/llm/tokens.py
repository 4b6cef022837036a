"""Token ids of many texts at once, by the tokenizers library inside Spark tasks.

A byte-level BPE splits a text before its merges: always before a single space
or line break that stands between other characters, and between a letter or
digit and a comma or full stop. So texts are cut there, each different word of
a batch is looked up or encoded once, and the ids are put together again: the
same ids as from encoding the whole text. Texts with other white space (two in
a row, or at an end) or with the character NUL are encoded whole.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_WHITE = r"[\x09-\x0d\x1c-\x20\x{85}\p{Z}]"
#: Not to be cut at all (or holding the mark that cuts are made with); and not to be cut before commas and full stops.
_UNSAFE = f"{_WHITE}{_WHITE}|^{_WHITE}|{_WHITE}$|^$|\\x00"
_ODD_MARKS = r"[^\p{L}\p{N}][,.][ \n]|^[,.]"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of texts without special tokens. Keeps the ids of at most ``most`` words; beyond that it starts afresh."""

    def __init__(self, path: str, most: int = 1 << 18):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        size = self.tokenizer.get_vocab_size()
        names = [self.tokenizer.id_to_token(i) or "" for i in range(size)]
        self.after_space = np.array([x.startswith("Ġ") for x in names])
        self.line_break = np.array([x == "Ċ" for x in names])
        self._clear()

    def _clear(self) -> None:
        self.slots: dict[str, int] = {}
        self.seen = np.zeros(1 << 16, np.int8)
        self.begin, self.length = np.empty(1 << 16, np.int64), np.empty(1 << 16, np.int64)
        self.ids, self.used = np.empty(1 << 18, np.uint32), 0

    def _forget(self) -> None:
        """Keep the words that more than one batch has had."""
        often = np.flatnonzero(self.seen[: len(self.slots)] > 1)
        words, begin, length, ids = list(self.slots), self.begin[often], self.length[often], self.ids
        self._clear()
        if 2 * len(often) < self.most:
            at = np.cumsum(length) - length
            self._store([words[i] for i in often.tolist()], ids[np.arange(length.sum()) + np.repeat(begin - at, length)], at)
            self.seen[: len(often)] = 1

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        marks = [w for w in words if w[0] == "\x00"]
        if marks:
            alone = self._whole([w[1:] for w in marks])
            self._store(marks, np.concatenate(alone), np.cumsum([0, *(len(x) for x in alone[:-1])]))
        for kind, starts in (([w for w in words if w[0] not in "\n\x00"], self.after_space), ([w for w in words if w[0] == "\n"], self.line_break)):
            lead = " " if starts is self.after_space else ""
            for lo in range(0, len(kind), 2000):
                own = kind[lo : lo + 2000]
                ids = self._whole([lead + lead.join(own)])[0]
                at = np.flatnonzero(starts[ids])
                if len(at) != len(own):  # not as expected for some word: take each alone
                    alone = self._whole([lead + w for w in own])
                    ids, at = np.concatenate(alone), np.cumsum([0, *(len(x) for x in alone[:-1])])
                self._store(own, ids, at)

    def _store(self, words: list[str], ids: np.ndarray, at: np.ndarray) -> None:
        n, m = len(self.slots), len(words)
        while n + m > len(self.begin):
            self.begin, self.length, self.seen = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.length, self.seen))
        while self.used + len(ids) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.ids[self.used : self.used + len(ids)] = ids
        self.begin[n : n + m] = at + self.used
        self.length[n : n + m] = np.diff(np.append(at, len(ids)))
        self.slots.update(zip(words, range(n, n + m), strict=True))
        self.used += len(ids)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and where each text's ids begin."""
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, _UNSAFE).to_numpy(zero_copy_only=False)
        count, out = np.zeros(len(texts), np.int64), np.empty(0, np.uint32)
        if not odd.all():
            plain = texts.filter(pa.array(~odd))
            uncut = pc.match_substring_regex(plain, _ODD_MARKS)
            for sign in ",.":
                for white in " \n":
                    plain = pc.if_else(uncut, plain, pc.replace_substring(plain, sign + white, f" \x00{sign}{white}"))
            plain = pc.binary_join_element_wise(pa.scalar("\n", plain.type), pc.replace_substring(plain, "\n", " \n"), pa.scalar("", plain.type))
            lists = pc.split_pattern(plain, " ")
            coded = pc.dictionary_encode(lists.flatten())
            words = coded.dictionary.to_pylist()
            if len(self.slots) + len(words) > self.most:
                self._forget()
            self._learn([w for w in words if w not in self.slots])
            slot = np.fromiter(map(self.slots.__getitem__, words), np.int64, len(words))
            self.seen[slot] = np.minimum(self.seen[slot], 100) + 1
            slot = slot[coded.indices.to_numpy()]
            length, begin = self.length[slot], self.begin[slot]
            last = np.cumsum(pc.list_value_length(lists).to_numpy())
            start = np.concatenate(([0], last[:-1]))
            length[start] -= 1  # without the line break put before each text
            begin[start] += 1
            end = np.cumsum(length)
            index = np.repeat((begin - (end - length)).astype(np.int32), length)
            index += np.arange(len(index), dtype=np.int32)
            out = self.ids[index]
            count[~odd] = np.diff(np.append(0, end[last - 1]))
        if odd.any():
            alone = self._whole(texts.filter(pa.array(odd)).to_pylist())
            count[odd] = [len(x) for x in alone]
            begin = np.concatenate(([0], np.cumsum(count)))
            merged = np.empty(begin[-1], np.uint32)
            is_odd = np.repeat(odd, count)
            merged[~is_odd] = out
            merged[is_odd] = np.concatenate(alone)
            return merged, begin
        return out, np.concatenate(([0], np.cumsum(count)))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each file in each Python worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def with_end(ids: np.ndarray, begin: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's ids followed by end_id."""
    n = len(begin) - 1
    out = np.full(len(ids) + n, end_id, np.uint32)
    keep = np.ones(len(out), bool)
    keep[begin[1:] + np.arange(n)] = False
    out[keep] = ids
    return out, begin + np.arange(n + 1)
