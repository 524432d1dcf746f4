"""Whole-text encoding with a public tokenizer; ids of recurring pieces are kept per worker."""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Pieces kept per encoder and generation; of a full one, those that are met again move to the next. As many words of texts that are cut by bytes are kept beside them. Only speed and memory depend on it.
KEPT = 200_000
#: Characters of texts whose pieces are held at a time.
HELD = 1_000_000
#: Bytes of texts that are cut into words at a time.
BLOCK = 4_000_000
#: A longer text's ids could be more than an Arrow column holds; it is cut into pieces as other texts are.
LONGEST = 1 << 28
#: A digit is a word of its own at word level; it stands between pieces that are encoded together.
MARK = "7"
#: Fixed value: a pattern that a vocabulary may split words by, and what it comes to within the ASCII characters and Latin-1 letters of LATIN, lower-case.
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
LATIN = bytes([10, *range(32, 127), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)])
LATIN_SPLIT = re.compile(r"[a-zß-öø-ÿ]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[!-/:-@\[-`{-~]+")
#: By byte of Latin-1: the lower-case letter, and what kind WORD_SPLIT takes it for.
LOWER = bytes(range(256)).decode("latin-1").translate({c: chr(c).lower() for c in LATIN}).encode("latin-1")
LETTER, DIGIT, OTHER = 1, 2, 3  # 0: what stands between words
KINDS = bytes(0 if c not in LATIN or c in b" \n" else LETTER if chr(c).isalpha() else DIGIT if c in b"0123456789" else OTHER for c in range(256))
#: By byte of UTF-8, at byte level: a blank belongs to what follows it, a line feed stands alone, and beyond ASCII the kind is not told (but see ``spaced_words``).
BLANK, LINE, HIGH = 4, 5, 6  # 0: what stands between texts
SPACED_KINDS = bytes([*(0 if c == 0 else LINE if c == 10 else BLANK if c == 32 else KINDS[c] or OTHER for c in range(128)), *[HIGH] * 128])
#: White space of Latin-1 other than blanks and line feeds.
WHITE = b"\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"


#: Words and their ids.
NO_WORDS = pa.array([], pa.binary()), pa.array([], pa.binary())


def latin(text: str) -> bytes | None:
    """A text of LATIN's characters only in Latin-1, lower-case; None for others."""
    try:
        raw = text.encode("latin-1")
    except UnicodeEncodeError:
        return None
    return None if raw.translate(None, LATIN) else raw.translate(LOWER)


def latin_words(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """Words of texts as ``latin`` gives them, as LATIN_SPLIT finds them, all texts' in turn, and how many words there are up to each text's end."""
    data = b"\n".join([*texts, b"\n"])  # what ends a text, and two bytes to look ahead
    kinds = np.frombuffer(data.translate(KINDS), dtype=np.uint8)
    cut = np.ones(len(kinds), dtype=bool)
    np.not_equal(kinds[1:], kinds[:-1], out=cut[1:])
    if any(d in data for d in b"0123456789"):
        cut |= kinds == DIGIT
    _keep_endings(data, cut)
    return _cut_out(data, kinds, cut, b" \n", texts)


def _keep_endings(data: bytes, cut: np.ndarray) -> None:
    """Changes ``cut`` so that 's and its like are words, where the mark begins one."""
    if b"'" not in data:
        return
    raw = np.frombuffer(data, dtype=np.uint8)
    at = np.flatnonzero(raw == ord("'"))
    at = at[cut[at]]
    for ending in (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d"):
        found = at[raw[at + 1] == ending[0]]
        found = found[raw[found + len(ending)] == ending[-1]]
        cut[found + 1] = False
        cut[found + 1 + len(ending)] = True


def _cut_out(data: bytes, kinds: np.ndarray, cut: np.ndarray, between: bytes, texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The words that begin where ``cut`` says, without the bytes ``between`` them (kind 0), and how many there are up to each text's end."""
    begins = np.flatnonzero(cut)
    word = kinds[begins] > 0
    offsets = np.append(0, np.cumsum(np.diff(begins, append=len(kinds))[word])).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data.translate(None, between))])
    return words, np.searchsorted(begins[word], np.cumsum([len(t) + 1 for t in texts]))


def spaced_words(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """Parts of UTF-8 texts whose ids in turn are the texts' at byte level, and how many there are up to each text's end.

    A part is what the vocabulary's pattern finds (a blank and the word after it, marks, a line feed), or some of that in
    turn: letters of Latin-1 are told; next to other characters beyond ASCII nothing is cut but before a blank and about a line feed."""
    data = b"\0".join([*texts, b"\0\0"])
    kinds = np.frombuffer(data.translate(SPACED_KINDS), dtype=np.uint8)
    if not data.isascii():
        raw, kinds = np.frombuffer(data, dtype=np.uint8), kinds.copy()
        lead = np.flatnonzero(raw == 0xC3)
        lead = lead[~np.isin(raw[lead + 1], (0x97, 0xB7))]  # the signs of multiplication and division
        kinds[lead] = kinds[lead + 1] = LETTER
    cut = np.ones(len(kinds), dtype=bool)
    np.not_equal(kinds[1:], kinds[:-1], out=cut[1:])
    cut[1:] &= kinds[:-1] != BLANK
    high = np.flatnonzero(kinds == HIGH)
    if len(high):
        cut[high] &= (kinds[high - 1] == LINE) | (kinds[high - 1] == 0)
        after = high + 1
        cut[after] &= (kinds[after] == BLANK) | (kinds[after] == LINE) | (kinds[after] == 0)
        # A mark after such a character may begin 's, or not.
        mark = after[np.frombuffer(data, dtype=np.uint8)[after] == ord("'")]
        cut[mark + 1] &= kinds[mark + 1] != LETTER
    cut[0] = True
    _keep_endings(data, cut)
    return _cut_out(data, kinds, cut, b"\0", texts)


class PieceEncoder:
    """Ids of a text as little-endian unsigned 32-bit integers, equal to encoding the whole text at once.

    A vocabulary that lower-cases and splits words (``_splits_words``) gets ASCII and Latin-1 texts as words, one at byte level texts as ``spaced_words`` cuts them. Else: both vocabularies split a text before every blank or line feed that follows another character, and merge
    nothing across such a place, so the ids of the pieces in turn are the ids of the text. Texts where that
    isn't certain (white space of other kinds, which may form runs with blanks, and marks that a normalizer could
    join to a piece's neighbour) are encoded whole."""

    def __init__(self, path: str, kept: int = KEPT):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.blank_matters = self.tokenizer.normalizer is None  # byte level: a blank belongs to the word after it
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.odd = re.compile(r"[^\S \n]|  |\n\n|[ \n]$| \n|[ \n][̀-ͯ]" if self.blank_matters else r"[^\S \n]|[ \n][̀-ͯ]")
        self.kept = kept
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.divides = not self.blank_matters and self._splits_words()
        self.known_words = self.older_words = NO_WORDS
        self.cut_special = [t.encode() for t in self.special]
        if self.divides:
            self.special = [t.lower() for t in self.special]
            self.cut_special = [x for x in map(latin, self.special) if x]
            # the model alone, for words that are lower-case and split already
            bare = json.loads(self.tokenizer.to_str()) | {"normalizer": None, "post_processor": None, "added_tokens": []}
            bare["pre_tokenizer"]["pretokenizers"][0] = {"type": "WhitespaceSplit"}
            self.words = Tokenizer.from_str(json.dumps(bare))
            self.last = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)  # tokens that end a word
            self.last[[i for t, i in self.words.get_vocab().items() if t.endswith(bare["model"]["end_of_word_suffix"])]] = True
        tokens = sorted(self.tokenizer.get_vocab().items(), key=lambda t: t[1])
        self.begins = np.zeros(tokens[-1][1] + 1, dtype=bool)  # tokens that begin with a blank (Ġ) or line feed (Ċ)
        self.begins[[i for t, i in tokens if t[0] in "ĠĊ"]] = True
        first = json.loads(self.tokenizer.to_str())["pre_tokenizer"] or {}
        spaced = self.blank_matters and first.get("type") == "ByteLevel" and first["use_regex"] and not first["add_prefix_space"]
        # a token of its own with a blank or line feed could stand where parts are learnt together, though not in a text
        self.spaced = spaced and not any(c in t for t in self.special for c in " \n")
        self.line = np.array(self.tokenizer.encode("\n", add_special_tokens=False).ids, dtype="<u4").tobytes()
        self.mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids[-1]

    def _splits_words(self) -> bool:
        """Whether the vocabulary lower-cases and splits as WORD_SPLIT says, so that parts of a piece have ids of their own."""
        made = json.loads(self.tokenizer.to_str())
        steps = (made["pre_tokenizer"] or {}).get("pretokenizers", [])
        first = steps[0] if steps else {}
        ended = made["model"].get("end_of_word_suffix")
        plain = ended and [x["type"] for x in steps[1:]] == ["ByteLevel"] and not steps[1]["use_regex"] and not steps[1]["add_prefix_space"]
        return plain and "Lowercase" in [n["type"] for n in made["normalizer"].get("normalizers", [])] and (first.get("pattern"), first.get("invert")) == ({"Regex": WORD_SPLIT}, True)

    def _ids_of(self, words: pa.Array) -> pa.Array:
        """The ids of each of the distinct ``words``, which are as ``latin_words`` or ``spaced_words`` gives them.

        They are kept as two Arrow columns, a quarter of what Python's objects take, in generations as pieces are."""
        at = pc.index_in(words, self.known_words[0]).fill_null(-1).to_numpy().copy()
        missing = np.flatnonzero(at < 0)
        if not len(missing):
            return self.known_words[1].take(pa.array(at))
        if len(self.known_words[0]) + len(missing) > self.kept:
            self.older_words, self.known_words = self.known_words, NO_WORDS
            missing = np.arange(len(words))
        before = pc.index_in(words.take(pa.array(missing)), self.older_words[0]).fill_null(-1).to_numpy()
        again, fresh = missing[before >= 0], missing[before < 0]
        new = words.take(pa.array(fresh))
        learnt, spelt = [], new.to_numpy(zero_copy_only=False).tolist()
        if self.spaced:
            for i in range(0, len(spelt), 256):
                learnt += self._learn_spaced(spelt[i : i + 256])
        else:
            for i in range(0, len(spelt), 1024):
                learnt += self._learn_words(b" ".join(spelt[i : i + 1024]).decode("latin-1"))
        at[again] = np.arange(len(again)) + len(self.known_words[0])
        at[fresh] = np.arange(len(fresh)) + len(self.known_words[0]) + len(again)
        kept = self.older_words[1].take(pa.array(before[before >= 0]))
        self.known_words = pa.concat_arrays([self.known_words[0], words.take(pa.array(again)), new]), pa.concat_arrays([self.known_words[1], kept, pa.array(learnt, pa.binary())])
        return self.known_words[1].take(pa.array(at))

    def _learn_words(self, run: str) -> list[bytes]:
        """The ids of each word in ``run``; they stand between blanks."""
        ids = np.array(self.words.encode_batch_fast([run], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = (4 * (np.flatnonzero(self.last[ids]) + 1)).tolist()
        raw = ids.tobytes()
        return [raw[x:y] for x, y in zip([0, *ends], ends, strict=False)]

    def _learn_spaced(self, words: list[bytes]) -> list[bytes]:
        """The ids of each of ``words``. One without a blank is learnt after a line feed, which stands alone whatever follows."""
        spelt = [w if w[0] in " \n" else f"\n{w}" for w in b"\0".join(words).decode().split("\0")]
        self._learn(spelt)
        ids = [self.known.pop(w) for w in spelt]
        return [x[len(self.line) :] if w[0] == "\n" and len(w) > 1 else x for w, x in zip(spelt, ids, strict=True)]

    def _know(self, pieces: set[str]) -> None:
        """Sees to it that ``known`` has all ``pieces``."""
        missing = pieces.difference(self.known)
        if len(self.known) + len(missing) > self.kept:
            self.older, self.known = self.known, {}
            missing = pieces
        again = self.older.keys() & missing
        self.known.update([(p, self.older[p]) for p in again])
        missing = missing.difference(again)
        words = [p for p in missing if LATIN_SPLIT.fullmatch(p)] if self.divides else []
        for i in range(0, len(words), 1024):
            some = words[i : i + 1024]
            self.known.update(zip(some, self._learn_words(" ".join(some)), strict=True))
        other = [*missing.difference(words)]
        for i in range(0, len(other), 1024):
            self._learn(other[i : i + 1024])

    def _learn(self, pieces: list[str]) -> None:
        """Encodes pieces run together, which is about half the work, and cuts the ids apart again; one by one where that is in doubt."""
        if self.blank_matters:  # a piece that begins with a blank or line feed and goes on
            joined = [p for p in pieces if p[:1] in (" ", "\n") and len(p) > 1]
        else:  # one that has no mark of its own
            joined = [p for p in pieces if p and MARK not in p]
        alone = [] if len(joined) == len(pieces) else [*set(pieces).difference(joined)]
        if joined:
            run = "".join(joined) if self.blank_matters else f" {MARK} ".join(joined)
            ids = np.array(self.tokenizer.encode_batch_fast([run], add_special_tokens=False)[0].ids, dtype="<u4")
            if self.blank_matters:
                cut = np.flatnonzero(self.begins[ids])
                spans = zip(cut.tolist(), [*cut[1:].tolist(), len(ids)])
            else:
                cut = np.flatnonzero(ids == self.mark)
                spans = zip([0, *(cut + 1).tolist()], [*cut.tolist(), len(ids)])
            if len(cut) == len(joined) - (not self.blank_matters):
                raw = ids.tobytes()
                self.known.update(zip(joined, [raw[4 * i : 4 * j] for i, j in spans], strict=True))
            else:
                alone = pieces
        if alone:
            for p, e in zip(alone, self.tokenizer.encode_batch_fast(alone, add_special_tokens=False)):
                self.known[p] = np.array(e.ids, dtype="<u4").tobytes()

    def _whole(self, text: str) -> bool:
        """Whether ``odd`` is in the text; told faster where all is Latin-1."""
        try:
            raw = text.encode("latin-1")
        except UnicodeEncodeError:
            return bool(self.odd.search(text))
        if len(raw.translate(None, WHITE)) < len(raw):
            return True
        return self.blank_matters and (raw[-1] in b" \n" or b"  " in raw or b"\n\n" in raw or b" \n" in raw)

    def _raw(self, text: str) -> bytes | None:
        """A text as it is cut into words by bytes; None where it isn't."""
        if len(text) > LONGEST:
            return None
        if self.divides:
            raw = latin(text)
        else:
            raw = text.encode() if self.spaced and "\x00" not in text and not self._whole(text) else None
        return None if raw is None or len(raw) > LONGEST or any(s in raw for s in self.cut_special) else raw

    def _pieces(self, text: str) -> list[str]:
        if not self.blank_matters:
            return text.replace("\n", " ").split(" ")
        return text.replace("\n", " \n").replace(" ", "\x00 ").replace("\x00 \n", "\x00\n").split("\x00")

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text. What is missing is learnt for about HELD characters of texts together."""
        out: list[bytes] = [b""] * len(texts)
        held, size = [], 0
        block, filled = [], 0

        def flush():
            pieces = set().union(*[p for _, p in held])
            if not pieces <= self.known.keys():
                self._know(pieces)
            known = self.known
            for i, p in held:
                out[i] = b"".join([known[x] for x in p])
            held.clear()

        def flush_block():
            for i, ids in zip([i for i, _ in block], self._encode_words([raw for _, raw in block]), strict=True):
                out[i] = ids
            block.clear()

        for i, text in enumerate(texts):
            if not text:
                continue
            raw = self._raw(text)
            if raw is not None:
                block.append((i, raw))
                filled += len(raw)
                if filled > BLOCK:
                    flush_block()
                    filled = 0
                continue
            seen = text.lower() if self.divides else text
            if self._whole(text) or "\x00" in text or any(s in seen for s in self.special):
                out[i] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
                continue
            held.append((i, self._pieces(text)))
            size += len(text)
            if size > HELD:
                flush()
                size = 0
        flush()
        if block:
            flush_block()
        return out

    def _encode_words(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text that ``_raw`` gives. Words are told apart by Arrow's dictionary, so only those to be learnt become Python's objects."""
        words, upto = (spaced_words if self.spaced else latin_words)(texts)
        coded = words.dictionary_encode()
        taken = self._ids_of(coded.dictionary).take(coded.indices)
        if not len(taken):
            return [b""] * len(texts)
        ends = np.append(0, np.frombuffer(taken.buffers()[1], dtype=np.int32, count=len(taken) + 1)[upto]).tolist()
        raw = memoryview(taken.buffers()[2])
        return [bytes(raw[x:y]) for x, y in zip(ends, ends[1:], strict=False)]


@lru_cache(maxsize=4)
def encoder(path: str, kept: int = KEPT) -> PieceEncoder:
    return PieceEncoder(path, kept)
