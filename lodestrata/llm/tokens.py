"""Token ids from a public tokenizer file, by the ``tokenizers`` library.

Texts repeat words far more than they repeat texts. Where the tokenizer's rules make it exact, a text is
cut at single spaces and each distinct piece is encoded once and remembered; other texts are encoded
whole. The memory is bounded: a generation holds about ``REMEMBERED`` pieces and is then kept as the one before until
the next is full; pieces of more than ``LONGEST`` characters aren't kept beyond their call, so that a piece takes 1 kB at
most and about 260 bytes on average (200 MB of a process for both generations). A text that may hold an added token of the
tokenizer is encoded whole, so that it becomes what the library makes of it.

- Byte-level rules (a space joins the word after it): a piece is a space and the run up to the next
  space. A text with white space after a space is encoded whole, for such a run is split otherwise.
- Word rules (white space dropped, word ends marked): any space is a boundary.
"""

from __future__ import annotations

import json
import os
import re
from itertools import filterfalse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces of a generation, characters of the longest that is kept, and words of a call of the model.
REMEMBERED, LONGEST, JOINED = 400_000, 64, 64
#: Bytes of text that callers give to ``encode`` at once: the more, the fewer distinct pieces to look up for each text.
TEXT_BYTES = 2 << 20
#: Marks that are split from a word before them.
MARKS = frozenset(".,;:!?")
#: Byte-level form of the letters U+00C0 to U+00FF: each of a letter's two bytes as the character that stands for it.
BYTES = {i: "".join(chr(b) if 0xA1 <= b <= 0xAC or 0xAE <= b else "\u0143" if b == 0xAD else chr(0xA2 + b) for b in chr(i).encode()) for i in range(0xC0, 0x100)}
_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each process and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def folded(text: str) -> str:
    """The text in lower case, where that is sure to be what the rules make of it: Latin-1 has neither combining nor context-dependent letters."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text.lower()


def simple(word: str) -> bool:
    """Whether a word of letters has only those of ASCII and U+00C0 to U+00FF."""
    return word.isascii() or all(c < "\x80" or "\xc0" <= c <= "\xff" for c in word)


class Encoder:
    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the unit of parallelism
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        self.t = Tokenizer.from_file(path)
        rules = json.loads(self.t.to_str())
        self.size = self.t.get_vocab_size()
        self.memory: dict[str, bytes | bool] = {}
        self.older: dict[str, bytes | bool] = {}
        self.long: list[str] = []
        pre, norm = rules.get("pre_tokenizer") or {}, rules.get("normalizer")
        self.kind, self.model = "whole", Tokenizer.from_file(path)
        #: What an added token begins with: signs that the rules leave as they are.
        self.added = {re.match(r"[!-/:-@\[-`{-~]*", x.content)[0] for x in self.t.get_added_tokens_decoder().values()}
        self.marks = {c: self._bytes(c) for c in MARKS}
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and norm is None:
            self.kind = "lead"
            lead = np.zeros(self.size, bool)
            lead[[i for w, i in self.t.get_vocab().items() if w.startswith("Ġ")]] = True
            self.lead = lead
            self.model.pre_tokenizer = WhitespaceSplit()  # what is left of the rules for a word of letters
        elif rules["model"].get("end_of_word_suffix") and norm and {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "} in norm.get("normalizers", []):
            bar = self._ids("|")
            if len(bar) == 1:
                self.kind, self.bar = "ends", bar[0]
                final = np.zeros(self.size, bool)  # what a word of letters ends with, and nothing else in it is
                final[[i for w, i in self.t.get_vocab().items() if w.endswith(rules["model"]["end_of_word_suffix"])]] = True
                self.final = final
                self.model.normalizer = None
                self.model.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        if "" in self.added:
            self.kind = "whole"

    def _ids(self, text: str) -> list[int]:
        return self.t.encode(text, add_special_tokens=False).ids

    def _bytes(self, text: str) -> bytes:
        return np.array(self._ids(text), np.uint32).tobytes()

    def _cut(self, t, words: list[str], plain: bool) -> list[bytes]:
        """Ids of words, many to a call, cut where a word begins."""
        lead = self.kind == "lead"
        if plain and lead:
            joined = ["Ġ" + " Ġ".join(words[i : i + JOINED]).translate(BYTES) for i in range(0, len(words), JOINED)]
        else:
            between = " " if lead or plain else " | "
            joined = [" " * lead + between.join(words[i : i + JOINED]) for i in range(0, len(words), JOINED)]
        out: list[bytes] = []
        for k, e in enumerate(t.encode_batch_fast(joined, add_special_tokens=False)):
            group = words[k * JOINED : (k + 1) * JOINED]
            ids = np.array(e.ids, np.uint32)
            raw = ids.tobytes()
            if lead:
                first = (np.flatnonzero(self.lead[ids]) * 4).tolist()
                last = [*first[1:], len(raw)]
            elif plain:
                last = (np.flatnonzero(self.final[ids]) * 4 + 4).tolist()
                first = [0, *last[:-1]]
            else:
                cut = np.flatnonzero(ids == self.bar) * 4
                first, last = [0, *(cut + 4).tolist()], [*cut.tolist(), len(raw)]
            if len(first) == len(group) and first[0] == 0 and last[-1:] == [len(raw)]:
                out += [raw[i:j] for i, j in zip(first, last, strict=True)]
            else:
                out += [self._bytes(" " + w if lead else w) for w in group]
        return out

    def _learn(self, pieces: list[str]) -> dict[str, bytes | bool]:
        """The ids of new pieces. Letters alone, or letters and one mark after them, need only the model; the mark is a
        word of its own by either kind of rules, unless lower-casing puts a combining letter before it."""
        out: dict[str, bytes | bool] = {}
        plain, tailed, other, lead = [], [], [], self.kind == "lead"
        for p in pieces:
            if p.isalpha():
                plain.append(p)
            elif p[-1:] in MARKS and p[:-1].isalpha() and (lead or simple(p[:-1])):
                tailed.append(p)
            elif lead and (not p or p[0].isspace()):
                out[p] = False
            elif not p:
                out[p] = b""
            elif not lead and "|" in p:
                out[p] = self._bytes(p)
            else:
                other.append(p)
        new = {*plain, *(b for p in tailed if (b := p[:-1]) not in self.memory)}
        easy, hard = [], other
        for w in new:
            (easy if simple(w) and (lead or w == w.lower()) else hard).append(w)
        plainest = list(filter(str.isascii, easy))  # in calls of their own
        easy = [*plainest, *filterfalse(str.isascii, easy)]
        out.update(zip(easy, self._cut(self.model, easy, True), strict=True))
        out.update(zip(hard, self._cut(self.t, hard, False), strict=True))
        for p in tailed:
            base = p[:-1]
            out[p] = (out[base] if base in out else self.memory[base]) + self.marks[p[-1]]
        return out

    def _remember(self, new: set[str]) -> None:
        """See to it that every piece is in the memory."""
        again = new & self.older.keys()
        self.memory.update(zip(again, map(self.older.__getitem__, again), strict=True))
        new -= again
        if new:
            learnt = self._learn(list(new))
            self.long = [p for p in learnt if len(p) > LONGEST]
            self.memory.update(learnt)

    def _turn(self) -> None:
        """Begin a new generation where one is full."""
        for p in self.long:
            self.memory.pop(p, None)
        self.long = []
        if len(self.memory) > REMEMBERED:
            self.older, self.memory = self.memory, {}

    def rest(self) -> None:
        """A task ends: forget the pieces that are too long to be kept."""
        self._turn()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        whole = lambda some: [np.array(e.ids, np.uint32).tobytes() for e in self.t.encode_batch_fast(some, add_special_tokens=False)]
        if self.kind == "whole":
            return whole(texts)
        apart = [i for i, t in enumerate(texts) if any(x in t for x in self.added)]
        if apart:
            out, gone = dict(zip(apart, whole([texts[i] for i in apart]), strict=True)), set(apart)
            out |= zip([i for i in range(len(texts)) if i not in gone], self._pieces([t for i, t in enumerate(texts) if i not in gone]), strict=True)
            return [out[i] for i in range(len(texts))]
        return self._pieces(texts)

    def _pieces(self, texts: list[str]) -> list[bytes]:
        """``encode`` for texts without an added token: cut and numbered in Arrow, only distinct pieces looked up, ids gathered by number."""
        self._turn()
        lead = self.kind == "lead"
        cut = pc.split_pattern(pa.array(texts if lead else list(map(folded, texts)), pa.large_string()), " ")
        coded = cut.flatten().dictionary_encode()
        begin, at, pieces = cut.offsets.to_numpy(), coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        heads = begin[:-1]
        if lead:  # the first pieces are encoded apart: no space stands before them
            used = np.ones(len(at), bool)
            used[heads] = False
            met = np.bincount(at[used], minlength=len(pieces)) > 0
            for i in np.flatnonzero(~met).tolist():
                pieces[i] = "."
        found = list(map(self.memory.get, pieces))
        if None in found:
            self._remember({p for p, x in zip(pieces, found) if x is None})
            found = [self.memory[p] if x is None else x for p, x in zip(pieces, found)]
        apart: set[int] = set()
        if False in found:  # pieces that white space begins
            bad = np.array([x is False for x in found])
            apart = set(np.flatnonzero(np.logical_or.reduceat(bad[at], heads)).tolist())
            found = [x or b"" for x in found]
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        ids, first = np.frombuffer(b"".join(found), np.uint32), np.cumsum(size) - size
        del found, pieces, coded
        n = size[at]
        if lead:
            n[heads] = 0
        ends = np.cumsum(n)
        whole = int(ends[-1]) if len(ends) else 0
        places = np.arange(whole, dtype=np.int32 if max(whole, len(ids)) < 1 << 31 else np.int64)
        places += np.repeat((first[at] - (ends - n)).astype(places.dtype), n)
        raw = ids[places]
        del places
        stop = ends[begin[1:] - 1].tolist()
        out = []
        for k, (t, i, j) in enumerate(zip(texts, [0, *stop], stop)):
            if k in apart:
                out.append(self._bytes(t))
            elif lead:
                h = t.partition(" ")[0]
                out.append((self._bytes(h) if h else b"") + raw[i:j].tobytes())
            else:
                out.append(raw[i:j].tobytes())
        return out
