"""BM25 for many queries at once, in cells of nodes.

Pairs of queries and nodes grow with the product of both, so no row is made of
them. Nodes go to cells by hash; a cell writes the postings of all words that
are asked for as arrays (`encoded`), and a task has one cell and one block of
queries and gives the best nodes of that cell for each query (`scored`).
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

K1, B = 1.2, 0.75
LIST_COLUMNS = "cell int, term string, df bigint, nodes binary, tfs binary, first int, ids array<{0}>, lens binary, n_docs bigint, n_words bigint"
IDS_PER_ROW = 20_000
# Ranks are rounded to 6 digits before ids decide: scores that lie nearer than this may tie.
SLACK = 2e-6


def _packed(values: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(values, np.int32).tobytes(), codec="zstd", asbytes=True) if len(values) else b""


def _unpacked(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, 4 * n, codec="zstd", asbytes=True), np.int32) if n else np.empty(0, np.int32)


def _totals(at: np.ndarray, weights: np.ndarray | None, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers below ``n`` in ``at``, sorted, and how often each occurs or the sum of its weights."""
    if len(at) > n // 8:
        total = np.bincount(at, weights, n)
        found = np.flatnonzero(total)
        return found, total[found]
    found, inverse = np.unique(at, return_inverse=True)
    return found, np.bincount(inverse, weights, len(found))


def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A cell's postings. Rows in: ``cell`` with ``asked`` (a term), or with ``node_id``, ``doc_len``, ``words`` and ``counts`` (null: each once; a null length is the number of words).

    Rows out: one for each term that begins a word (``df``, ``nodes``, ``tfs``),
    and the cell's nodes in order of their ids (``first``, ``ids``, ``lens``).
    Rows of one id and one length are one document, though each counts for the means.
    """
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held)
    cell = table.column("cell")[0].as_py()
    asked = sorted(x for x in pc.unique(table.column("asked")).to_pylist() if x)
    docs = table.filter(pc.greater(pc.fill_null(pc.list_value_length(table.column("words")), 0), 0))
    if not docs.num_rows:
        return
    docs = docs.set_column(docs.column_names.index("doc_len"), "doc_len", pc.coalesce(docs.column("doc_len"), pc.list_value_length(docs.column("words")).cast(pa.int64())))
    docs = docs.take(pc.sort_indices(docs.select(["node_id", "doc_len"]), sort_keys=[("node_id", "ascending"), ("doc_len", "ascending")], null_placement="at_end")).combine_chunks()
    whose = _codes(docs.column("node_id"))
    lens = docs.column("doc_len").to_numpy()
    new = np.concatenate(([True], (whose[1:] != whose[:-1]) | (lens[1:] != lens[:-1])))
    pair = np.cumsum(new) - 1
    n = int(pair[-1]) + 1

    lists = docs.column("words").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    at = pair[pc.list_parent_indices(lists).to_numpy()]
    weights = _weights(docs, len(at))
    coded = pc.list_flatten(lists).dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    words = coded.dictionary.take(pa.array(order)).to_pylist()
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    by_word = place[coded.indices.to_numpy()]
    begins = np.concatenate(([0], np.cumsum(np.bincount(by_word, minlength=len(words)))))
    sort = np.argsort(by_word, kind="stable")
    at, weights = at[sort].astype(np.int32), None if weights is None else weights[sort]

    rows = []
    for term in asked:
        low, high = bisect_left(words, term), bisect_left(words, term + "\U0010ffff")
        if low < high:
            part = slice(begins[low], begins[high])
            nodes, tfs = _totals(at[part], None if weights is None else weights[part], n)
            rows.append({"cell": cell, "term": term, "df": len(nodes), "nodes": _packed(nodes), "tfs": _packed(tfs)})
    kept = np.flatnonzero(new)
    ids = docs.column("node_id").take(pa.array(kept)).combine_chunks()
    ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
    schema = pa.schema([("cell", pa.int32()), ("term", pa.string()), ("df", pa.int64()), ("nodes", pa.binary()), ("tfs", pa.binary()), ("first", pa.int32()), ("ids", pa.list_(ids.type)), ("lens", pa.binary()), ("n_docs", pa.int64()), ("n_words", pa.int64())])
    for first in range(0, n, IDS_PER_ROW):
        rows.append({"cell": cell, "first": first, "ids": ids.slice(first, IDS_PER_ROW).to_pylist(), "lens": _packed(lens[kept[first : first + IDS_PER_ROW]]), "n_docs": 0 if first else docs.num_rows, "n_words": 0 if first else int(lens.sum())})
    for i in range(0, len(rows), 500):
        yield pa.RecordBatch.from_pylist(rows[i : i + 500], schema=schema)


def _codes(values: pa.ChunkedArray) -> np.ndarray:
    """A number for each distinct value, null being one."""
    coded = values.combine_chunks()
    coded = (coded.chunk(0) if isinstance(coded, pa.ChunkedArray) else coded).dictionary_encode(null_encoding="encode")
    return coded.indices.to_numpy()


def _weights(docs: pa.Table, n: int) -> np.ndarray | None:
    """The counts of all words in order, or None where rows list each word as often as it occurs."""
    if docs.column("counts").null_count == docs.num_rows:
        return None
    flat = pc.list_flatten(docs.column("counts"))
    assert len(flat) == n, "a count for each word"
    return flat.to_numpy().astype(np.float64)


class Cell:
    """The postings of a cell as scores: of each term the nodes, numbered by id, and what the term adds to them."""

    def __init__(self, lists: pa.Table, mean: float):
        rows = lists.filter(pc.is_valid(lists.column("ids"))).sort_by("first")
        ids = pc.list_flatten(rows.column("ids"))
        lens = np.concatenate([_unpacked(x.as_py(), len(i)) for x, i in zip(rows.column("lens"), rows.column("ids"))])
        whose = _codes(ids)
        new = np.concatenate(([True], whose[1:] != whose[:-1]))
        self.node = np.cumsum(new) - 1 if not new.all() else None  # of a document; an id may have documents of several lengths
        self.ids = ids.take(pa.array(np.flatnonzero(new))) if self.node is not None else ids
        self.n = len(self.ids)
        self.norm = K1 * (1 - B + B * lens / mean)
        stored = lists.filter(pc.is_valid(lists.column("term")))
        self.stored = {t: (df, nodes, tfs) for t, df, nodes, tfs in zip(*[stored.column(c).to_pylist() for c in ("term", "df", "nodes", "tfs")])}
        self.scores: dict[str, tuple[np.ndarray, np.ndarray] | None] = {}

    def term(self, term: str, idf: float) -> tuple[np.ndarray, np.ndarray] | None:
        """Nodes and scores, or None if the cell has no word that begins so."""
        if term not in self.scores:
            self.scores[term] = self._scores(*self.stored.pop(term), idf) if term in self.stored else None
        return self.scores[term]

    def _scores(self, df: int, nodes: bytes, tfs: bytes, idf: float) -> tuple[np.ndarray, np.ndarray]:
        at, tf = _unpacked(nodes, df).astype(np.intp), _unpacked(tfs, df).astype(np.float64)  # other indices are converted at every use
        s = idf * tf * (K1 + 1) / (tf + self.norm[at])
        return (at, s) if self.node is None else _totals(self.node[at], s, self.n)

    def best(self, terms: list[str], idfs: list[float], limit: int, acc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first ``limit`` nodes by rounded score and id, and their rounded scores. ``acc``: ``n`` zeros, given back as zeros.

        Terms are added in one order in all cells, so equal documents get equal sums.
        """
        own = [x for t, i in zip(terms, idfs) if (x := self.term(t, i))]
        if not own:
            return np.empty(0, np.intp), np.empty(0)
        for at, s in own:
            acc[at] += s
        # The nodes of one list already tell a score that the result's last one reaches.
        few = min((at for at, _ in own if len(at) >= limit), key=len, default=None)
        floor = _floor(acc[few], limit) - SLACK if few is not None else 0.0
        found = np.flatnonzero(acc >= floor if floor > 0 else acc > 0)
        sums = acc[found]
        acc[:] = 0
        if len(found) > limit:
            stay = sums >= _floor(sums, limit) - SLACK
            found, sums = found[stay], sums[stay]
        rounded = np.floor(sums * 1e6 + 0.5) / 1e6
        order = np.lexsort((found, -rounded))[:limit]
        return found[order], rounded[order]


def _floor(values: np.ndarray, limit: int) -> float:
    """The ``limit``-th greatest value."""
    return float(np.partition(values, len(values) - limit)[len(values) - limit])


def scored(batches: Iterator[pa.RecordBatch], mean: float, limit: int) -> Iterator[pa.RecordBatch]:
    """The best nodes of one cell for each query of one block: ``query_id``, ``node_id``, ``rank``.

    Rows in: those of `encoded`, and queries as ``query_id``, ``terms`` and ``idfs``.
    """
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held)
    asked = table.filter(pc.is_valid(table.column("terms")))
    lists = table.filter(pc.is_null(table.column("terms")))
    if not asked.num_rows or not lists.num_rows:
        return
    cell = Cell(lists, mean)
    acc = np.zeros(cell.n)
    for begin in range(0, asked.num_rows, 2000):
        part = asked.slice(begin, 2000)
        each = [cell.best(terms, idfs, limit, acc) for terms, idfs in zip(part.column("terms").to_pylist(), part.column("idfs").to_pylist())]
        query = np.repeat(np.arange(len(each)), [len(x[0]) for x in each])
        node = np.concatenate([x[0] for x in each])
        ranks = 0.0 - np.concatenate([x[1] for x in each])
        columns = [part.column("query_id").take(pa.array(query)), cell.ids.take(pa.array(node)), pa.chunked_array([pa.array(ranks)])]
        yield from pa.table(columns, names=["query_id", "node_id", "rank"]).combine_chunks().to_batches()
