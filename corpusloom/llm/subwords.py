"""Encoding of many texts by a ``tokenizers`` file, with a memory of units.

A text is cut at places where the tokenizer's own pre-tokenizer always cuts,
each distinct unit is encoded once by the library, and texts are put together
from the remembered ids with numpy.  The ids equal those of encoding the whole
text.  Cutting and finding the distinct units of a batch is done by Arrow, so
Python only sees each batch's distinct units.

* ``lower`` files (white space dropped): cut at every space and line feed.
* ``bytes`` files (byte-level, a space joins the word after it): cut before a
  space that is followed by anything but white space, and around a single line
  feed between two other characters.  There the pattern's ``\\s+(?!\\S)``
  leaves exactly the last space to the next word, so no piece spans the cut.
* ``spaced``: as ``bytes``, of texts with one space put before them, and names
  of special tokens are plain text.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator, Sequence
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from corpusloom.llm import store

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

_BEFORE_WORD = re.compile(r"(?= \S)")
#: A unit that ends in one of these after an ASCII letter has the ids of the rest, then those of the mark.
_MARKS = frozenset(".,;:!?")
#: Texts that ``lower`` files don't take in lower case: beyond Latin-1, or with the name of a special token.
_NOT_LOWERED = r"[^\x00-\xff]|<\|"
#: Texts of ``bytes`` files with other white space than single spaces and line feeds between words.
_NOT_SINGLE = r"^$|^[ \n]|[ \n]$|[ \n][ \n]|[\x00\x01\t\x0b-\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Units that are encoded in one call of the library; those of a run that can't be told apart are tried in shorter runs, then alone.
_RUNS = (1024, 32)
_ENCODERS: dict[tuple[str, str], UnitEncoder] = store.left("encoders")


def _lower_units(texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
    """Units of all texts and how many each has.  Lower case first where Arrow's
    and the library's agree on every letter and no special token's name can come of it."""
    odd = pc.match_substring_regex(texts, _NOT_LOWERED)
    cut = pc.split_pattern(pc.replace_substring(pc.if_else(odd, texts, pc.utf8_lower(texts)), "\n", " "), " ")
    return cut.flatten(), pc.list_value_length(cut).to_numpy(zero_copy_only=False)


def _spaced_units(texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
    """Units of the texts with one space before them."""
    return _byte_units(texts, " ")


def _byte_units(texts: pa.StringArray, before: str = "") -> tuple[pa.StringArray, np.ndarray]:
    """Keys: a bare word stands for the word with a space before it; \\x00 marks
    a text's first word, \\x01 a unit as it is."""
    odd = pc.match_substring_regex(texts, _NOT_SINGLE)
    marked = pc.if_else(odd, "", texts if before else pc.binary_join_element_wise("\x00", texts, ""))
    cut = pc.split_pattern(pc.replace_substring(marked, "\n", " \n"), " ")
    count = pc.list_value_length(cut).to_numpy(zero_copy_only=False).astype(np.int64)
    if not pc.any(odd).as_py():
        return cut.flatten(), count
    # Units of odd texts are put in place of the one empty unit that stands for them.
    units = [["\x01" + u for u in _BEFORE_WORD.split(before + t) if u] for t in texts.filter(odd).to_pylist()]
    which = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
    place = np.arange(int(count.sum()))
    begin = np.cumsum(count) - count
    per = np.fromiter(map(len, units), np.int64, len(units))
    longer = np.ones(len(place), np.int64)
    longer[begin[which]] = per
    source = np.repeat(place, longer)
    added = len(place) + np.arange(int(per.sum()))
    source[np.repeat(np.isin(place, begin[which]), longer)] = added
    count[which] = per
    flat = pa.concat_arrays([cut.flatten(), pa.array([u for some in units for u in some], pa.string())])
    return flat.take(pa.array(source)), count


def _byte_unit_text(key: str) -> str:
    if key[:1] in ("\x00", "\x01"):
        return key[1:]
    return key if key[:1] == "\n" else " " + key


def _byte_length(tokenizer, kind: str) -> np.ndarray:
    """Bytes of text that each id stands for (byte-level files: one character of the token a byte)."""
    names = tokenizer.get_vocab(with_added_tokens=True)
    special = {i: t.content for i, t in tokenizer.get_added_tokens_decoder().items()}
    out = np.zeros(max(names.values()) + 1, np.int64)
    for name, i in names.items():
        out[i] = len(special[i].encode()) if i in special else len(name.removesuffix("</w>") if kind == "lower" else name)
    return out


class UnitEncoder:
    """Encodes texts; holds at most ``most`` distinct units before it starts anew."""

    def __init__(self, path: str, kind: str, most: int = 500_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocab_size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.units_of, self.text_of, self.between, self.alone = {
            "lower": (_lower_units, str, " ", ()),
            "bytes": (_byte_units, _byte_unit_text, "", ("\x00", "\x01")),
            "spaced": (_spaced_units, _byte_unit_text, "", ("\x00", "\x01")),
        }[kind]
        self.tokenizer.encode_special_tokens = kind == "spaced"
        self.kind, self.most = kind, most
        self.byte_length = _byte_length(self.tokenizer, kind)
        self.known: dict[str, int] = {}
        self._hold(np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64))

    def _hold(self, ids: np.ndarray, count: np.ndarray, uses: np.ndarray) -> None:
        self.used, self.units = len(ids), len(count)
        self.pool = np.concatenate([ids, np.zeros(1 << 20, np.int32)])
        self.begin, self.count, self.uses = (np.concatenate([x, np.zeros(1 << 18, np.int64)]) for x in (np.cumsum(count) - count, count, uses))

    def _forget(self) -> None:
        """Keep the half of the units that was used most."""
        kept = np.sort(np.argsort(-self.uses[: self.units], kind="stable")[: self.most // 2])
        kept = kept[np.cumsum(self.count[kept]) <= 4 * self.most]
        marks = [self.known[self.mark_key(m)] for m in _MARKS]
        kept = np.union1d(kept, marks)
        number = np.full(self.units, -1, np.int64)
        number[kept] = np.arange(len(kept))
        self.known = {k: int(n) for k, i in self.known.items() if (n := number[i]) >= 0}
        count = self.count[kept]
        before = np.cumsum(count) - count
        ids = self.pool[np.repeat(self.begin[kept] - before, count) + np.arange(count.sum())]
        self._hold(ids, count, self.uses[kept] // 2)

    def _library(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the units and how many each has.

        Units are encoded in runs, which costs the library half of what single
        units cost; the bytes that ids stand for tell the units of a run apart.
        """
        count = np.zeros(len(keys), np.int64)
        left = np.array([i for i, k in enumerate(keys) if k[:1] not in self.alone and (self.alone or k.split() == [k])], np.int64)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        for size in _RUNS:
            left, where, ids = self._in_runs(keys, left, size, count)
            done.append((where, ids))
        single = np.setdiff1d(np.arange(len(keys)), np.concatenate([w for w, _ in done]))
        found = [e.ids for e in self.tokenizer.encode_batch_fast([self.text_of(keys[i]) for i in single.tolist()], add_special_tokens=False)]
        count[single] = np.fromiter(map(len, found), np.int64, len(found))
        done.append((single, np.array([i for ids in found for i in ids], np.int32)))
        # Back into the order of the keys.
        where, flat = np.concatenate([w for w, _ in done]), np.concatenate([x for _, x in done])
        before = np.zeros(len(keys), np.int64)
        before[where] = np.cumsum(count[where]) - count[where]
        return flat[np.repeat(before - (np.cumsum(count) - count), count) + np.arange(len(flat))], count

    def _in_runs(self, keys: list[str], which: np.ndarray, size: int, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Encode ``keys[which]`` in runs, set their ``count``; gives those that failed, those that didn't, and the latter's ids."""
        nothing = np.zeros(0, np.int64), np.zeros(0, np.int32)
        if not len(which):
            return which, *nothing
        runs = [which[at : at + size] for at in range(0, len(which), size)]
        texts = [self.between.join([self.text_of(keys[i]) for i in run.tolist()]) for run in runs]
        units = [self.tokenizer.normalizer.normalize_str(t).split(" ") for t in texts] if self.kind == "lower" else [[self.text_of(keys[i]) for i in run.tolist()] for run in runs]
        found = [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        dues = [pc.binary_length(pa.array(u, pa.string())).to_numpy(zero_copy_only=False).astype(np.int64) for u in units]
        fine = [len(d) == len(run) and len(ids) and d[0] > 0 and d.sum() == self.byte_length[ids].sum() for d, run, ids in zip(dues, runs, found, strict=True)]
        failed = [run for run, ok in zip(runs, fine, strict=True) if not ok]
        good, where, flat = [], [], []
        for run, due, ids, ok in zip(runs, dues, found, fine, strict=True):
            if not ok:
                continue
            ends, due = np.cumsum(self.byte_length[ids]), np.cumsum(due)
            cuts = np.searchsorted(ends, due, "left") + 1
            if not (ends[cuts - 1] == due).all():
                failed.append(run)
                continue
            # The last unit takes what stands for no bytes at the end.
            cuts[-1] = len(ids)
            good.append(np.diff(cuts, prepend=0))
            where.append(run)
            flat.append(ids)
        failing = np.concatenate(failed) if failed else nothing[0]
        if not where:
            return failing, *nothing
        done = np.concatenate(where)
        count[done] = np.concatenate(good)
        return failing, done, np.concatenate(flat)

    def _add(self, keys: list[str], flat: np.ndarray, count: np.ndarray) -> None:
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while self.units + len(keys) > len(self.begin):
            self.begin, self.count, self.uses = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.count, self.uses))
        self.pool[self.used : self.used + len(flat)] = flat
        new = slice(self.units, self.units + len(keys))
        self.begin[new], self.count[new], self.uses[new] = self.used + np.cumsum(count) - count, count, 0
        self.known.update(zip(keys, range(new.start, new.stop), strict=True))
        self.used += len(flat)
        self.units += len(keys)

    def _gather(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        count = self.count[which]
        before = np.zeros(len(which) + 1, np.int64)
        np.cumsum(count, out=before[1:])
        return self.pool[np.repeat(self.begin[which] - before[:-1], count) + np.arange(before[-1])], before

    def _learn(self, keys: list[str]) -> None:
        """Encode new units; those that are a unit and a mark after it are put together.

        Only after an ASCII letter: others may end in a combining mark once the
        tokenizer has normalised them, which its pattern joins to the mark.
        """
        made = [k for k in keys if k[-1:] in _MARKS and k[-2:-1].isascii() and k[-2:-1].isalpha() and k[:1] not in self.alone]
        put = set(made)
        plain = [k for k in keys if k not in put]
        marks = [self.mark_key(m) for m in _MARKS] if not self.units else []
        fresh = [k for k in dict.fromkeys([*marks, *plain, *(k[:-1] for k in made)]) if k not in self.known and k not in put]
        for at in range(0, len(fresh), 20_000):
            some = fresh[at : at + 20_000]
            self._add(some, *self._library(some))
        pairs = np.array([(self.known[k[:-1]], self.known[self.mark_key(k[-1])]) for k in made], np.int64).reshape(-1, 2)
        ids, before = self._gather(pairs.ravel())
        self._add(made, ids, np.diff(before[::2]))

    def mark_key(self, mark: str) -> str:
        return mark if self.kind == "lower" else "\x01" + mark

    def encode(self, texts: Sequence[str] | pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and where each text's ids begin (one more entry than texts)."""
        if self.units > self.most or self.used > 8 * self.most:
            self._forget()
        units, per = self.units_of(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        ends = np.concatenate([[0], np.cumsum(per)])
        coded = units.dictionary_encode()
        codes, keys = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        which = np.fromiter(map(self.known.get, keys, repeat(-1)), np.int64, len(keys))
        new = np.flatnonzero(which < 0)
        if len(new):
            fresh = [keys[i] for i in new.tolist()]
            self._learn(fresh)
            which[new] = np.fromiter(map(self.known.__getitem__, fresh), np.int64, len(fresh))
        self.uses[which] += np.bincount(codes, minlength=len(keys))
        ids, before = self._gather(which[codes])
        return ids, before[ends]


def slices(texts: pa.StringArray, most: int = 2_500_000) -> Iterator[tuple[int, pa.StringArray]]:
    """Cuts of about ``most`` bytes, or one text, with the place where each begins."""
    total = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        before = total[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(total, before + most, "right")))
        yield at, texts.slice(at, end - at)
        at = end


def encoder(path: str, kind: str) -> UnitEncoder:
    """One encoder for each Python worker and file; workers are used again by later tasks, which keep it if ``tidy`` has "encoders" as their owner."""
    if (path, kind) not in _ENCODERS:
        _ENCODERS[path, kind] = UnitEncoder(path, kind)
    return _ENCODERS[path, kind]
