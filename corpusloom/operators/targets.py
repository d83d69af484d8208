"""Which facts are about which of many targets, in one pass over the facts.

Targets of checked number are an index in every Python worker: a fact's text or
fields are searched for all terms at once, and only what is about a target is
given away, so nothing grows with the targets that share a common term.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import containment

#: Rows of targets and terms that an index may have, and pairs that are looked at together.
MOST_ROWS, MOST_PAIRS = 1_000_000, 1_000_000
_built: dict[str, ahocorasick.Automaton] = {}


def fits(terms: DataFrame, most_rows: int) -> bool:
    """Whether ``terms`` (query_id, term) can be an index."""
    rows = terms.agg(F.count(F.lit(1))).first()[0]
    return rows <= most_rows and terms.select("term").distinct().agg(F.coalesce(F.sum(F.length("term")), F.lit(0))).first()[0] <= containment.MOST_CHARS


def _places(begin: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For stretches of n places from begin: the stretch of every place, and the places."""
    return np.repeat(np.arange(len(n)), n), np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def _parts(n: np.ndarray) -> Iterator[slice]:
    """Stretches of ``n`` that add up to ``MOST_PAIRS`` at most, or have one entry."""
    ends, begin = np.cumsum(n), 0
    while begin < len(n):
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + MOST_PAIRS, "right")))
        yield slice(begin, end)
        begin = end


@dataclass(frozen=True)
class _Index:
    """Terms, targets, and the targets (places in ``queries``) of every key, sorted by key.

    A key is a term, or a target's first owner and a descriptor (owner * number of terms + descriptor). A target's
    other owners are ``more``, from ``begin`` of the target on.
    """

    name: str
    queries: pa.Array
    terms: list[str]
    keys: np.ndarray
    targets: np.ndarray
    begin: np.ndarray
    more: np.ndarray
    owners: np.ndarray
    descriptors: np.ndarray

    @staticmethod
    def of(terms: DataFrame, descriptors: DataFrame | None = None) -> _Index:
        """``terms`` and ``descriptors``: query_id, term, each once; all targets of one are in the other, too."""
        found = [d.select("query_id", "term").toArrow() for d in (terms, descriptors) if d is not None]
        queries, words = (pc.unique(pa.chunked_array([c for t in found for c in t[name].chunks], found[0][name].type)) for name in ("query_id", "term"))
        q, t = ([pc.index_in(f[name], values).to_numpy(zero_copy_only=False).astype(np.int64) for f in found] for name, values in (("query_id", queries), ("term", words)))
        n, owner, key, target = len(words), np.zeros(len(queries), np.int64), t[0], q[0]
        begin, more = np.zeros(len(queries) + 1, np.int64), np.empty(0, np.int64)
        if descriptors is not None:
            # The longest owner leads, as it is in the fewest texts.
            order = np.lexsort((t[0], -pc.utf8_length(words).to_numpy(zero_copy_only=False)[t[0]], q[0]))
            q0, t0 = q[0][order], t[0][order]
            first = np.ones(len(q0), bool)
            first[1:] = q0[1:] != q0[:-1]
            owner[q0[first]] = t0[first]
            more, begin = t0[~first], np.searchsorted(q0[~first], np.arange(len(queries) + 1))
            key, target = owner[q[1]] * n + t[1], q[1]
        order = np.argsort(key, kind="stable")
        owners, others = np.zeros(n, bool), np.zeros(n, bool)
        owners[owner if descriptors is not None else []] = True
        others[t[-1]] = True
        return _Index(uuid.uuid4().hex, queries, words.to_pylist(), key[order], target[order], begin, more, owners, others)

    def hits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Places of texts and of the terms in them, by text, each once."""
        if self.name not in _built:
            _built.clear()
            made = ahocorasick.Automaton()
            for i, term in enumerate(self.terms):
                made.add_word(term, i)
            made.make_automaton()
            _built[self.name] = made
        made, row, term = _built[self.name], [], []
        for i, text in enumerate(texts):
            inside = {v for _, v in made.iter(text)}
            row.extend([i] * len(inside))
            term.extend(inside)
        return np.array(row, np.int64), np.array(term, np.int64)

    def given(self, facts: pa.Array, row: np.ndarray, key: np.ndarray, hits: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        """What the rows' keys ask for, each target once a row. ``hits``: row * number of terms + term of all hits, sorted; ``row`` is sorted."""
        begin = np.searchsorted(self.keys, key, "left")
        n = np.searchsorted(self.keys, key, "right") - begin
        row, begin, n = row[n > 0], begin[n > 0], n[n > 0]
        # A row isn't divided, as its targets are told apart together.
        rows, first = np.unique(row, return_index=True)
        for part in _parts(np.add.reduceat(n, first) if len(first) else n):
            some = slice(first[part.start], first[part.stop] if part.stop < len(first) else len(row))
            at, place = _places(begin[some], n[some])
            pair = np.unique(row[some][at] * len(self.queries) + self.targets[place])
            where, target = pair // len(self.queries), pair % len(self.queries)
            if hits is not None and len(self.more):
                at, place = _places(self.begin[target], self.begin[target + 1] - self.begin[target])
                missing = np.bincount(at, ~np.isin(where[at] * len(self.terms) + self.more[place], hits), minlength=len(target)) > 0
                where, target = where[~missing], target[~missing]
            yield pa.RecordBatch.from_arrays([self.queries.take(pa.array(target)), facts.take(pa.array(where))], ["query_id", "fact_id"])

    def in_fields(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Facts (fact_id, fields) with a field that equals a term, or contains one of three or more characters."""
        fields = batch.column(1)
        values = fields.flatten().dictionary_encode()
        known = values.dictionary.to_pylist()
        field, term = self.hits(known)
        fine = np.fromiter((len(self.terms[t]) >= 3 or self.terms[t] == known[f] for f, t in zip(field.tolist(), term.tolist(), strict=True)), bool, len(field))
        field, term = field[fine], term[fine]
        row = np.repeat(np.arange(len(fields)), pc.list_value_length(fields).to_numpy(zero_copy_only=False))
        value = values.indices.to_numpy(zero_copy_only=False)
        begin = np.searchsorted(field, value, "left")
        at, place = _places(begin, np.searchsorted(field, value, "right") - begin)
        yield from self.given(batch.column(0), row[at], term[place])

    def in_text(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Facts (fact_id, text) whose text has all owners and a descriptor."""
        row, term = self.hits(batch.column(1).to_pylist())
        n = len(self.terms)
        owned, described = self.owners[term], self.descriptors[term]
        per = np.bincount(row[described], minlength=batch.num_rows)
        begin, objects, hits = np.cumsum(per) - per, term[described], np.sort(row * n + term)
        row, owner = row[owned], term[owned]
        rows, first = np.unique(row, return_index=True)
        for part in _parts(np.add.reduceat(per[row], first) if len(first) else first):
            some = slice(first[part.start], first[part.stop] if part.stop < len(first) else len(row))
            at, place = _places(begin[row[some]], per[row[some]])
            yield from self.given(batch.column(0), row[some][at], owner[some][at] * n + objects[place], hits)


def _search(facts: DataFrame, index: _Index, query_type: str, how: str) -> DataFrame:
    sent = facts.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from getattr(sent.value, how)(batch)

    return facts.mapInArrow(run, f"query_id {query_type}, fact_id {facts.schema['fact_id'].dataType.simpleString()}")


def by_fields(facts: DataFrame, terms: DataFrame) -> DataFrame:
    """query_id, fact_id of facts (fact_id, fields without nulls) with a field that equals a term, or contains one of three or more characters. ``terms``: query_id, term."""
    return _search(facts.select("fact_id", "fields"), _Index.of(terms), terms.schema["query_id"].dataType.simpleString(), "in_fields")


def by_text(facts: DataFrame, owners: DataFrame, descriptors: DataFrame) -> DataFrame:
    """query_id, fact_id of facts (fact_id, text without nulls) whose text has all owners of a target and any of its descriptors. Both: query_id, term, of the same targets."""
    return _search(facts.select("fact_id", "text"), _Index.of(owners, descriptors), owners.schema["query_id"].dataType.simpleString(), "in_text")
