"""Token ids of whole texts, word by word where that gives exactly what the library gives.

The two BPE tokenizer files split a text before their merges, never across a space that a non-space
follows.  So each distinct word is encoded once per worker, by the library, and
a text's ids are gathered from a table in numpy.  A text in which a cut could change the ids (white space after white
space, a special string), and any tokenizer file of another form, is encoded whole.  The byte-level split also ends every
run of letters, so there a sign after a letter starts a word, and a word of letters alone, one piece of
that split, goes to the library's model itself.
"""

from __future__ import annotations

import functools
import json
import os
import re
from itertools import chain

import numpy as np

from gaugework.llm.word_hash import mix, powers

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
_U = np.uint64
_BASE = 0xA0761D6478BD642F
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = np.random.Generator(np.random.PCG64(5)).integers(1, 2**63, size=256, dtype=np.uint64) * _U(2) + _U(1)
#: Entries that a worker keeps; beyond them it starts anew.  Letters that are looked up at a time.
MOST_WORDS, CHUNK, MOST_COUNTED = 1_000_000, 400_000, 400_000
_AMBIGUOUS = re.compile(r"[ \n](?=\s)|\x01|<\|")
#: Bytes that white space begins with.
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[*range(9, 14), *range(28, 33), 0xC2, 0xE1, 0xE2, 0xE3]] = True
#: ASCII letters; ASCII signs; the last bytes of letters after C3 (all but the signs of times and division).
_LETTER, _SIGN, _LATIN = (np.zeros(256, dtype=bool) for _ in range(3))
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_SIGN[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_LATIN[[b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7)]] = True
#: Words that are one piece of the byte-level split: letters (of blocks where every place is one) after at most one space.
_LETTERS = re.compile("[ ]?[A-Za-zÀ-ÖØ-öø-ɏΈ-ΊΎ-ΡΣ-ώЀ-ҁא-תぁ-ゖァ-ヺ一-龥가-힣]+").fullmatch


class IdEncoder:
    """encode(texts) -> little-endian id bytes per text, of `dtype`."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        pre, norm = spec["pre_tokenizer"] or {}, spec["normalizer"]
        self.kind = "whole"
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and norm is None:
            self.kind = "byte"
        elif [x["type"] for x in (norm or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and [
            x["type"] for x in pre.get("pretokenizers", [])
        ] == ["Split", "ByteLevel"]:
            self.kind = "word"
        if not all(re.fullmatch(r"<\|\w+\|>", x["content"]) for x in spec["added_tokens"]):
            self.kind = "whole"
        if self.kind == "byte":
            from tokenizers.pre_tokenizers import ByteLevel

            # The letter that stands for each byte in the file's vocabulary: those that stand for themselves, the others from 256 on in order.
            own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
            self.letters = np.arange(256, dtype="<u4")
            self.letters[np.setdiff1d(np.arange(256), own)] = 256 + np.arange(256 - len(own))
            if sorted(map(ord, ByteLevel.alphabet())) != sorted(self.letters.tolist()):
                self.kind = "whole"
        self.table = _WordTable(self._segments, self.dtype)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.kind == "whole":
            return [self.whole(text) if text else b"" for text in texts]
        out = [b""] * len(texts)
        cut, size = [], 0
        for i, text in enumerate(texts):
            if text:
                cut.append(i)
                size += len(text)
            if cut and (size > CHUNK or i + 1 == len(texts)):
                raw = [texts[j].encode() for j in cut]
                if self.kind == "byte":
                    odd = {k for k in self._suspects(raw) if _AMBIGUOUS.search(texts[cut[k]])}
                    for k in odd:
                        out[cut[k]] = self.whole(texts[cut[k]])
                    if odd:
                        cut, raw = ([x for k, x in enumerate(some) if k not in odd] for some in (cut, raw))
                if cut:
                    for j, ids in zip(cut, self._by_words(raw)):
                        out[j] = ids
                cut, size = [], 0
        return out

    @staticmethod
    def _suspects(texts: list[bytes]) -> list[int]:
        """The texts that can be ambiguous, by their bytes; a few others too."""
        data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        after = np.append(data[1:], np.uint8(0))
        hits = ((data == 32) | (data == 10)) & _BLANK[after]
        hits |= data == 1
        hits |= (data == 60) & (after == 124)
        return np.unique(np.searchsorted(np.cumsum([len(t) for t in texts]), np.flatnonzero(hits), side="right")).tolist()

    def _by_words(self, texts: list[bytes]) -> list[bytes]:
        """The ids of texts cut before every space (and, where white space is dropped, line feed, else after it, and before a sign after a letter)."""
        data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        ends = np.cumsum([len(t) for t in texts])
        begin = data == 32
        feeds = data == 10
        if self.kind == "word":
            begin |= feeds
        else:
            begin[1:] |= feeds[:-1]
            letter = _LETTER[data]
            letter[1:] |= (data[:-1] == 0xC3) & _LATIN[data[1:]]
            begin[1:] |= letter[:-1] & _SIGN[data[1:]]
        begin[0] = True
        begin[ends[:-1]] = True
        start = np.flatnonzero(begin)
        stop = np.append(start[1:], len(data))
        lengths, first, flat = self.table.find(data, start, stop)
        tokens = np.concatenate([[0], np.cumsum(lengths)])
        ids = flat[np.repeat(first - tokens[:-1], lengths) + np.arange(tokens[-1])].tobytes()
        bounds = tokens[np.searchsorted(start, np.concatenate([[0], ends]))] * self.dtype.itemsize
        return [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]

    def _segments(self, segments: list[bytes]) -> list[list[int]]:
        """The ids of words as cut: with the space before them, and the line feed after them."""
        words = [x.decode() for x in segments]
        if self.kind == "word":
            words = [x[1:] if x[:1] in (" ", "\n") else x for x in words]
            return [x.ids for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        # Of words of letters the split has nothing to cut: the model takes them, a letter for each byte.
        shown = self.letters[np.frombuffer(b"".join(segments), dtype=np.uint8)].tobytes().decode("utf-32-le")
        made, rest, tokens_of, at = [], [], self.tokenizer.model.tokenize, 0
        for i, (word, raw) in enumerate(zip(words, segments)):
            end = at + len(raw)
            if _LETTERS(word):
                made.append([t.id for t in tokens_of(shown[at:end])])
            else:
                made.append(None)
                rest.append(i)
            at = end
        for i, x in zip(rest, self.tokenizer.encode_batch_fast([words[i] for i in rest], add_special_tokens=False)):
            made[i] = x.ids
        return made


class _WordTable:
    """Ids by word, in arrays: words are found by a hash of their bytes and told apart by length and the bytes at both ends.

    A word of up to 16 bytes is compared whole; a longer one needs an equal 64-bit hash besides.  New words are encoded once
    and join a small sorted part, which joins the large one when it has grown.
    """

    def __init__(self, make, dtype: np.dtype) -> None:
        self.make, self.dtype = make, dtype
        self.clear()

    def clear(self) -> None:
        none = np.zeros(0, dtype=np.uint64)
        few = np.zeros(0, dtype=np.int32)
        self.parts = [(none, few) for _ in range(2)]  # sorted hashes, word numbers
        self.head, self.tail, self.size = none, none, few
        self.lengths, self.first, self.flat = few, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=self.dtype)

    def find(self, data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(tokens, first token) per word, and the ids that they point to."""
        n = len(data)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTES[data] * powers(_BASE, n), out=sums[1:])
        size = stop - start
        hashed = mix((sums[stop] - sums[start]) * powers(_INVERSE, n)[start] + size.astype(np.uint64))
        words, at, of = np.unique(hashed, return_index=True, return_inverse=True)
        padded = np.concatenate([np.zeros(8, dtype=np.uint8), data, np.zeros(8, dtype=np.uint8)])
        eight = np.lib.stride_tricks.sliding_window_view(padded, 8)
        few = np.minimum(size[at], 8)
        mask = np.where(few == 8, _U(0xFFFFFFFFFFFFFFFF), (_U(1) << (8 * few).astype(np.uint64)) - _U(1))
        head = np.ascontiguousarray(eight[start[at] + 8]).view(np.uint64).ravel() & mask
        tail = np.ascontiguousarray(eight[stop[at]]).view(np.uint64).ravel() >> (8 * (8 - few)).astype(np.uint64)
        if len(self.size) > MOST_WORDS:
            self.clear()
        number = np.full(len(words), -1)
        for known, numbers in self.parts:
            if len(known):
                place = np.minimum(np.searchsorted(known, words), len(known) - 1)
                hit = np.flatnonzero(known[place] == words)
                number[hit] = numbers[place[hit]]
        old = np.flatnonzero(number >= 0)
        m = number[old]
        wrong = old[(self.head[m] != head[old]) | (self.tail[m] != tail[old]) | (self.size[m] != size[at[old]])]
        fresh = np.flatnonzero(number < 0)
        number[fresh] = self._add(data, start[at[fresh]], stop[at[fresh]], words[fresh], head[fresh], tail[fresh])
        result = number[of]
        # Words whose hash is another word's, here or in the table, are looked up one by one.
        odd = (head[of] != self._ends(eight, start + 8, size, True)) | (tail[of] != self._ends(eight, stop, size, False)) | (size[at][of] != size)
        odd |= np.isin(of, wrong)
        for i in np.flatnonzero(odd).tolist():
            result[i] = self._add(data, start[i : i + 1], stop[i : i + 1], None, None, None)[0]
        return self.lengths[result].astype(np.int64), self.first[result], self.flat

    @staticmethod
    def _ends(eight: np.ndarray, at: np.ndarray, size: np.ndarray, head: bool) -> np.ndarray:
        few = np.minimum(size, 8)
        values = np.ascontiguousarray(eight[at]).view(np.uint64).ravel()
        if head:
            return values & np.where(few == 8, _U(0xFFFFFFFFFFFFFFFF), (_U(1) << (8 * few).astype(np.uint64)) - _U(1))
        return values >> (8 * (8 - few)).astype(np.uint64)

    def _add(self, data: np.ndarray, start: np.ndarray, stop: np.ndarray, hashed, head, tail) -> np.ndarray:
        """Encodes words and gives their numbers; without a hash they are not kept for later look-ups."""
        if not len(start):
            return np.zeros(0, dtype=np.int64)
        raw = data.tobytes()
        made = self.make([raw[a:b] for a, b in zip(start.tolist(), stop.tolist())])
        lengths = np.array([len(x) for x in made], dtype=np.int32)
        numbers = (len(self.size) + np.arange(len(start))).astype(np.int32)
        self.first = np.concatenate([self.first, len(self.flat) + np.cumsum(lengths, dtype=np.int64) - lengths])
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(made), dtype=self.dtype, count=int(lengths.sum()))])
        self.lengths, self.size = np.concatenate([self.lengths, lengths]), np.concatenate([self.size, (stop - start).astype(np.int32)])
        none = np.zeros(len(start), dtype=np.uint64)
        self.head, self.tail = np.concatenate([self.head, none if head is None else head]), np.concatenate([self.tail, none if tail is None else tail])
        if hashed is not None:
            (large, of), (small, its) = self.parts
            small, its = np.concatenate([small, hashed]), np.concatenate([its, numbers])
            if 4 * len(small) > len(large):
                large, of = np.concatenate([large, small]), np.concatenate([of, its])
                order = np.argsort(large)
                large, of, small, its = large[order], of[order], small[:0], its[:0]
            else:
                order = np.argsort(small)
                small, its = small[order], its[order]
            self.parts = [(large, of), (small, its)]
        return numbers


class PieceCounter:
    """count(texts) -> tokens per text of a sentencepiece model, without begin and end."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        # No piece joins a word to what stands before its space, and none holds a line feed.
        self.by_word = all("▁" not in p.lstrip("▁") and "\n" not in p for p in pieces) and (
            len(self.model.encode("a \n b  c")) == len(self.model.encode("a")) + 2 + len(self.model.encode("b")) + 1 + len(self.model.encode("c"))
        )
        self.words: dict[str, int] = {}

    def count(self, texts: list[str]) -> list[int]:
        out, known = [], self.words
        if len(known) > MOST_COUNTED:
            known.clear()
        for text in texts:
            parts = text.replace("\n", " \n")
            if not self.by_word or not text or "  " in parts or "▁" in text or parts[0] == " " or parts[-1] == " ":
                out.append(len(self.model.encode(text, num_threads=1)) if text else 0)
                continue
            words = parts.split(" ")
            try:
                out.append(sum([known[w] for w in words]))
            except KeyError:
                new = [w for w in dict.fromkeys(words) if w not in known]
                for w, ids in zip(new, self.model.encode(new, num_threads=1)):
                    known[w] = len(ids) - (w[0] == "\n")  # the mark before a line feed is no token of the text
                out.append(sum([known[w] for w in words]))
        return out


@functools.lru_cache(maxsize=2)
def id_encoder(path: str) -> IdEncoder:
    return IdEncoder(path)


@functools.lru_cache(maxsize=2)
def piece_counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def release() -> None:
    """Frees the tokenizers and tables that an earlier stage left in this worker: workers live on between stages."""
    id_encoder.cache_clear()
    piece_counter.cache_clear()
