"""Tokenizer encoding of Arrow text columns, one library call per distinct piece.

Texts are cut only between a non-space character and white space that follows
it, where no pre-token of the vocabularies used here can span. The pieces of a
batch are reduced to their distinct values by Arrow, and only pieces not met before
go to the tokenizers library. Where the file's pre-tokenizer is one of the two known
here, words of plain letters, with marks or line ends after them, go straight to its
merge model (each is a pre-token of its own); other pieces are joined by an added
token, so that one call encodes hundreds. The ids of each text are put together
again by array gathers. The result equals encoding every whole text.

Pieces are remembered within a bound in bytes. When it is reached, those met in one
batch only are forgotten, so a corpus full of rare words keeps its frequent ones.
"""

from __future__ import annotations

import json
import os
import re
import sys
import types
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BATCH_BYTES = 8 << 20  # text bytes worked on at a time
CACHE_BYTES = 128 << 20  # about what one Python worker remembers of pieces and their ids
PIECE_COST = 150  # bytes of a remembered piece besides its characters and ids
CALL_PIECES = 500
CALL_CHARS = 1 << 16  # a call's result takes some hundred bytes a token

# white space in every engine, then anything else; \x1c-\x1f are spaces to Python only
_OPEN_END = r"^$|^\n*[\t\v\f\r\p{Z}\x1c-\x1f\x{85}]|[\s\v\p{Z}\x1c-\x1f\x{85}]$"
_PIECE = re.compile(r"[^\S\x1c-\x1f]*[\S\x1c-\x1f]+|[^\S\x1c-\x1f]+")
# line ends, letters of one pre-token, marks of another; no letter that changes under NFC
_PLAIN = r"\A(?P<ends>\n*)(?P<stem>[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}]+)(?P<tail>[.,;:!?]*)\z"
# fixed values: the splitting pattern of word vocabularies, and how byte-level vocabularies spell bytes
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_SPELL = {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(_SHOWN)))}


def byte_groups(texts: pa.Array, limit: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; a longer text is a range of its own."""
    sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < len(texts):
        before = sizes[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(sizes, before + limit, "right")))
        yield lo, hi
        lo = hi


def _splitting(config: dict) -> str | None:
    """Which known way the file cuts texts into pre-tokens: "space" (one space
    belongs to the word after it), "word" (white space and case are dropped)."""
    before, cut = config["normalizer"], config["pre_tokenizer"] or {}
    steps = [x["type"] for x in (before or {}).get("normalizers", [])]
    parts = cut.get("pretokenizers", [])
    if before is None and cut.get("type") == "ByteLevel" and cut["use_regex"] and not cut["add_prefix_space"]:
        return "space"
    if steps == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in parts] == ["Split", "ByteLevel"]:
        if parts[0]["pattern"].get("Regex") == WORD_SPLIT and parts[0]["invert"] and not parts[1]["use_regex"] and not parts[1]["add_prefix_space"]:
            return "word"
    return None


class PieceEncoder:
    """Ids of texts under one vocabulary, with a cache of pieces bounded in bytes."""

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_padding()
        self.tok.no_truncation()
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.mark = self.special[0] if self.special else None
        self.mark_id = self.tok.token_to_id(self.mark) if self.mark else None
        self.splitting = _splitting(json.loads(self.tok.to_str()))
        if any(s.isalpha() for s in self.special):  # would be found inside a plain word
            self.splitting = None
        self.cache_bytes = cache_bytes
        # slots by piece: as it stands, after one space, and the same of plain stems;
        # line ends before a word. Slot 0 is the empty piece.
        self.known: dict[str, dict[str, int]] = {k: {"": 0} for k in ("bare", "spaced", "stem", "spaced stem", "ends")}
        self.lengths = np.zeros(1, np.int64)
        self.starts = np.zeros(1, np.int64)
        self.flat = np.zeros(0, np.uint32)
        self.cost = np.zeros(1, np.int64)  # bytes a slot takes
        self.met = np.zeros(1, np.int32)  # batches that met a slot since the last sweep

    def _sweep(self) -> None:
        """Beyond the bound, keep what several batches met, at most half the bound."""
        if self.cost.sum() <= self.cache_bytes:
            return
        least = 2
        keep = self.met >= least
        while self.cost[keep].sum() > self.cache_bytes // 2:
            least *= 2
            keep = self.met >= least
        keep[0] = True
        slot = np.cumsum(keep) - 1
        self.known = {k: {p: int(slot[i]) for p, i in known.items() if keep[i]} for k, known in self.known.items()}
        self.lengths, self.starts, self.flat = self._gathered(np.flatnonzero(keep)[:, None])
        self.cost, self.met = self.cost[keep], np.zeros(len(self.lengths), np.int32)

    def _gathered(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(lengths, starts, ids) of rows of slots, each row put together."""
        size = self.lengths[slots].ravel()
        before = np.cumsum(size) - size
        where = np.repeat(self.starts[slots].ravel() - before, size) + np.arange(int(size.sum()))
        whole = size.reshape(slots.shape).sum(axis=1)
        return whole, np.cumsum(whole) - whole, self.flat[where]

    def _one(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def _stems(self, stems: list[str], lead: str) -> Iterator[list[int]]:
        """Ids of plain letters, each a pre-token of its own."""
        tokenize = self.tok.model.tokenize
        for stem in stems:
            spelled = stem if stem.isascii() else stem.encode().decode("latin-1").translate(_SPELL)
            yield [t.id for t in tokenize(lead + spelled)]

    def _joined(self, pieces: list[str]) -> Iterator[list[int]]:
        """Ids of pieces that go through the whole tokenizer, some hundred a call."""
        sizes = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        lo = 0
        while lo < len(pieces):
            before = sizes[lo - 1] if lo else 0
            hi = min(lo + CALL_PIECES, max(lo + 1, int(np.searchsorted(sizes, before + CALL_CHARS, "right"))))
            group, lo = pieces[lo:hi], hi
            # an added token, or pieces that would spell one together, keep to themselves
            if self.mark is not None and not any(s[0] in p or s[-1] in p for s in self.special for p in group):
                ids = self.tok.encode_batch_fast([self.mark.join(group)], add_special_tokens=False)[0].ids
                cuts = [-1, *(i for i, x in enumerate(ids) if x == self.mark_id), len(ids)]
                if len(cuts) == len(group) + 1:
                    yield from (ids[a + 1 : b] for a, b in zip(cuts, cuts[1:], strict=False))
                    continue
            yield from map(self._one, group)

    def _encode(self, pieces: list[str], kind: str) -> Iterator[list[int]]:
        if kind.endswith("stem"):
            return self._stems(pieces, chr(_SPELL[0x20]) if kind == "spaced stem" else "")
        if kind == "ends":  # before a word the last white space is a pre-token of its own
            return (self._one(p[:-1]) + self._one(p[-1:]) for p in pieces)
        return self._joined([" " + p for p in pieces] if kind == "spaced" else pieces)

    def _slots(self, pieces: list[str], kind: str) -> np.ndarray:
        """Slots of distinct pieces."""
        known = self.known[kind]
        new = [p for p in pieces if p not in known]
        if new:
            found = list(self._encode(new, kind))
            lengths = np.fromiter(map(len, found), np.int64, len(found))
            ids = np.fromiter(chain.from_iterable(found), np.uint32, int(lengths.sum()))
            ends = len(self.flat) + np.cumsum(lengths)
            first = len(self.lengths)
            known.update(zip(new, range(first, first + len(new)), strict=True))
            cost = PIECE_COST + 4 * lengths + np.fromiter(map(sys.getsizeof, new), np.int64, len(new))
            self.lengths = np.concatenate((self.lengths, lengths))
            self.starts = np.concatenate((self.starts, ends - lengths))
            self.flat = np.concatenate((self.flat, ids))
            self.cost = np.concatenate((self.cost, cost))
            self.met = np.concatenate((self.met, np.zeros(len(new), np.int32)))
        slots = np.fromiter(map(known.__getitem__, pieces), np.int64, len(pieces))
        self.met[slots] += 1
        return slots

    def _distinct_slots(self, pieces: pa.Array, kind: str) -> np.ndarray:
        coded = pieces.dictionary_encode()
        return self._slots(coded.dictionary.to_pylist(), kind)[coded.indices.to_numpy(zero_copy_only=False)]

    def _parts(self, words: pa.Array, lead: str) -> np.ndarray:
        """Three slots a word: its line ends, its stem or the whole of it, its marks."""
        out = np.zeros((len(words), 3), np.int64)
        rest = np.ones(len(words), bool)
        if self.splitting:
            found = pc.extract_regex(words, _PLAIN)
            rest = found.is_null().to_numpy(zero_copy_only=False)
            plain = np.flatnonzero(~rest)
            found = found.take(pa.array(plain))
            ends, stems, tails = (found.field(k) for k in ("ends", "stem", "tail"))
            out[plain, 0] = self._distinct_slots(ends, "ends")
            out[plain, 2] = self._distinct_slots(tails, "bare")
            if self.splitting == "word":
                out[plain, 1] = self._distinct_slots(pc.utf8_lower(stems), "stem")
            else:
                after_space = pc.equal(ends, "").to_numpy(zero_copy_only=False) & (lead == " ")
                for kind, rows in (("spaced stem", after_space), ("stem", ~after_space)):
                    out[plain[rows], 1] = self._distinct_slots(stems.filter(pa.array(rows)), kind)
        rest = np.flatnonzero(rest)
        if len(rest):
            left = words.take(pa.array(rest)).to_pylist()
            after_space = np.fromiter((not w.startswith("\n") for w in left), bool, len(left)) & (lead == " ")
            for kind, rows in (("spaced", after_space), ("bare", ~after_space)):
                out[rest[rows], 1] = self._slots([left[i] for i in np.flatnonzero(rows)], kind)
        return out

    def _pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of every piece in text order, number of pieces of each text, slots of the rows)."""
        lists = pc.split_pattern(pc.replace_substring_regex(texts, r"(\n+)", r" \1"), " ")
        counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        # a cut is safe if neither side of the space is empty or white space
        open_end = pc.match_substring_regex(coded.dictionary, _OPEN_END).to_numpy(zero_copy_only=False)
        stops = np.cumsum(counts)
        heads = stops - counts
        if open_end.any():
            bad = np.add.reduceat(open_end[index].astype(np.int64), heads) > 0
            return self._mixed(texts, bad)
        first, at = np.unique(index[heads], return_inverse=True)
        index[heads] = len(coded.dictionary) + at
        table = [self._parts(coded.dictionary, " "), self._parts(coded.dictionary.take(pa.array(first)), "")]
        return index, counts, np.concatenate(table)

    def _mixed(self, texts: pa.Array, bad: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same where the rows in ``bad`` hold other runs of white space."""
        fine = np.flatnonzero(~bad)
        parts: dict[int, np.ndarray] = {}
        table = np.zeros((0, 3), np.int64)
        if len(fine):
            index, own, table = self._pieces(texts.take(pa.array(fine)))
            for row, part in zip(fine, np.split(index, np.cumsum(own)[:-1]), strict=True):
                parts[row] = part
        pieces: dict[str, int] = {}
        for row in np.flatnonzero(bad):
            cut = _PIECE.findall(texts[int(row)].as_py())
            parts[row] = np.fromiter((len(table) + pieces.setdefault(p, len(pieces)) for p in cut), np.int64, len(cut))
        added = np.zeros((len(pieces), 3), np.int64)
        added[:, 1] = self._slots(list(pieces), "bare")
        ordered = [parts[row] for row in range(len(texts))]
        return np.concatenate(ordered), np.fromiter(map(len, ordered), np.int64, len(ordered)), np.concatenate((table, added))

    def ids_of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids in text order, number of ids of each text); no nulls."""
        parts, lengths = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for lo, hi in byte_groups(texts):
            self._sweep()
            index, counts, table = self._pieces(texts.slice(lo, hi - lo))
            size, starts, flat = self._gathered(table)
            size, starts = size[index], starts[index]
            total = np.concatenate(([0], np.cumsum(size)))
            where = np.repeat(starts - total[:-1], size) + np.arange(total[-1])
            parts.append(flat[where])
            stops = np.cumsum(counts)
            lengths.append(total[stops] - total[stops - counts])
        return np.concatenate(parts), np.concatenate(lengths)

    def lengths_of(self, texts: pa.Array) -> np.ndarray:
        """Number of ids of each text; no nulls."""
        out = [np.zeros(0, np.int64)]
        for lo, hi in byte_groups(texts):
            self._sweep()
            index, counts, table = self._pieces(texts.slice(lo, hi - lo))
            total = np.concatenate(([0], np.cumsum(self.lengths[table].sum(axis=1)[index])))
            stops = np.cumsum(counts)
            out.append(total[stops] - total[stops - counts])
        return np.concatenate(out)


def per_worker(key: tuple, build: Callable):
    """``build()`` once per Python worker process, which outlives its tasks.

    Task functions travel by value, so a global of this module would last for
    one task only; the values hang on a module entry of the process instead.
    """
    name = "_counterpanel_llm_worker"
    holder = sys.modules.setdefault(name, types.ModuleType(name)).__dict__
    if key not in holder:
        holder[key] = build()
    return holder[key]


def encoder(path: str) -> PieceEncoder:
    """The encoder of a tokenizers file."""
    return per_worker(("tokenizers", path), lambda: PieceEncoder(path))


def piece_model(path: str):
    """A sentencepiece model."""
    import sentencepiece

    return per_worker(("pieces", path), lambda: sentencepiece.SentencePieceProcessor(model_file=path))


def token_lengths(texts: pa.Array, path: str) -> np.ndarray:
    """Token counts by the library that the file's suffix names; no nulls."""
    if path.endswith(".json"):
        return encoder(path).lengths_of(texts)
    if not path.endswith(".model"):
        raise ValueError(f"not a tokenizers (.json) or sentencepiece (.model) file: {path}")
    out = [np.zeros(0, np.int64)]
    for lo, hi in byte_groups(texts):
        ids = piece_model(path).encode(texts.slice(lo, hi - lo).to_pylist(), num_threads=1)
        out.append(np.fromiter(map(len, ids), np.int64, len(ids)))
    return np.concatenate(out)
