"""Scores of all claims for a block of questions in one pass: a tile of claims by questions at a time, the best of each task handed on.

Nothing is joined pair by pair.  A task holds a tile of scores, the broadcast terms of the questions and its best rows
so far, and reads its claims once; scores are whole millionths, so they round as one number and tie exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .asked import MOST, _automaton

#: Cells of a tile, and terms of claims that are spread over questions at once.
CELLS, SPREAD = 1 << 21, 1 << 21
MICRO = 1_000_000


class Best:
    """The best rows of each question that a task has met, by score, then by ``order``, in which its rows come."""

    def __init__(self, questions: int, limit: int):
        self.limit, self.bound = limit, np.full(questions, -np.inf)
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.waiting, self.most = 0, max(1 << 18, 2 * questions * limit)

    def add_tile(self, tile: np.ndarray, order: np.ndarray, *more: np.ndarray) -> None:
        """Scores of rows by questions, -inf for none; ``more`` are columns, or tiles, that go with them.  Later rows lose ties."""
        open_ = tile > self.bound
        if len(tile) > self.limit and np.count_nonzero(open_) > 4 * self.limit * tile.shape[1]:
            last = np.partition(tile, -self.limit, axis=0)[-self.limit]
            above, tied = tile > last, tile == last
            open_ &= above | (tied & (np.cumsum(tied, axis=0) <= self.limit - above.sum(axis=0)))
        row, q = np.nonzero(open_)
        self.parts.append((q, order[row], tile[row, q], *(x[row, q] if x.ndim == 2 else x[row] for x in more)))
        self.waiting += len(q)
        if self.waiting > self.most:
            self.settle()

    def settle(self) -> tuple[np.ndarray, ...] | None:
        if not self.parts:
            return None
        columns = [np.concatenate(x) for x in zip(*self.parts, strict=True)]
        at = np.lexsort((columns[1], -columns[2], columns[0]))
        q, score = columns[0][at], columns[2][at]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        last = place == self.limit - 1
        self.bound[q[last]] = score[last]
        at = at[place < self.limit]
        self.parts, self.waiting = [tuple(x[at] for x in columns)], 0
        return self.parts[0]


class Spread:
    """Terms by number with the questions that ask for each and a value: rows of (term, question, value), sorted by term."""

    def __init__(self, terms: np.ndarray, questions: np.ndarray, values: np.ndarray, count: int):
        at = np.argsort(terms, kind="stable")
        self.questions, self.values = questions[at], values[at]
        self.starts = np.searchsorted(terms[at], np.arange(count + 1))

    def over(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place in ``terms``, question and value of each use of a term."""
        counts = self.starts[terms + 1] - self.starts[terms]
        place = np.repeat(np.arange(len(terms)), counts)
        at = np.arange(len(place)) - np.repeat(np.cumsum(counts) - counts, counts) + self.starts[terms][place]
        return place, self.questions[at], self.values[at]

    def add(self, rows: np.ndarray, terms: np.ndarray, factor: np.ndarray | None, tile: np.ndarray) -> None:
        """Adds value (x factor) of each term of a row to the questions that ask for it.  ``rows`` and ``terms`` go together."""
        flat, width = tile.reshape(-1), tile.shape[1]
        uses = np.cumsum(self.starts[terms + 1] - self.starts[terms])
        a = 0
        while a < len(terms):
            b = max(a + 1, int(np.searchsorted(uses, (uses[a - 1] if a else 0) + SPREAD, side="right")))
            place, q, value = self.over(terms[a:b])
            flat += np.bincount(rows[a:b][place] * width + q, value if factor is None else value * factor[a:b][place], len(flat))
            a = b


def _runs(lengths: np.ndarray, width: int) -> Iterator[tuple[int, int]]:
    size = max(1, CELLS // max(1, width))
    return ((a, min(a + size, len(lengths))) for a in range(0, len(lengths), size))


def _flat(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Values of all lists and the length of each; a null is empty."""
    return column.flatten(), np.asarray(column.value_lengths().fill_null(0)).astype(np.int64)


def _sent(names: np.ndarray, types: list[pa.DataType], columns: tuple[np.ndarray, ...] | None, fields: list[str]) -> Iterator[pa.RecordBatch]:
    """The best rows in batches: question by name, score in ones, and further columns."""
    q, _, score, *more = columns or (np.empty(0, np.int64), None, np.empty(0))
    for a in range(0, len(q), 1 << 16):
        part = slice(a, a + (1 << 16))
        yield pa.RecordBatch.from_arrays([pa.array(names[q[part]], types[0]), pa.array(score[part] / MICRO), *(pa.array(x[part], pa.string()) for x in more)], fields)


def _questions(asked: pa.Table) -> tuple[np.ndarray, pa.DataType, np.ndarray]:
    """Names of the questions, their type, and each row's number of question."""
    column = asked.column("query_id").combine_chunks()
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    code = column.dictionary_encode()
    return code.dictionary.to_numpy(zero_copy_only=False), column.type, code.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def full_text(asked: DataFrame, claims: DataFrame, tokens: Column, limit: int, weight) -> DataFrame:
    """query_id, claim_id, bm25: each task's best claims by BM25 for asked(query_id, phrase, times).

    A phrase is one token or several with blanks between.  One pass counts the claims that hold each phrase, the next
    one scores them; ``weight`` is what a phrase adds before its idf.
    """
    spark = claims.sparkSession
    table = asked.select("query_id", "phrase", "times").toArrow()
    names, kind, question = _questions(table)
    code = pc.dictionary_encode(table.column("phrase").combine_chunks())
    code = code.combine_chunks() if isinstance(code, pa.ChunkedArray) else code
    phrases = code.dictionary.to_pylist()
    words = sorted({w for p in phrases for w in p.split(" ")})
    number = {w: i for i, w in enumerate(words)}
    single = np.full(len(words), -1)
    long = []
    for i, p in enumerate(phrases):
        parts = [number[w] for w in p.split(" ")]
        if len(parts) == 1:
            single[parts[0]] = i
        else:
            long.append((i, parts))
    shared = spark.sparkContext.broadcast((words, single, long))

    def found(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row, phrase and times of the phrases of a batch, by row, and each row's tokens."""
        words, single, long = shared.value
        flat, lengths = _flat(column)
        ids = pc.fill_null(pc.index_in(flat, pa.array(words, pa.string())), -1).to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(len(lengths)), lengths)
        one = np.where(ids >= 0, single[ids], -1) if len(words) else np.full(len(ids), -1)
        keys = [owner[one >= 0] * len(phrases) + one[one >= 0]]
        for i, parts in long:
            n = len(ids) - len(parts) + 1
            if n > 0:
                here = owner[:n] == owner[len(parts) - 1 :]
                for k, part in enumerate(parts):
                    here &= ids[k : k + n] == part
                keys.append(owner[:n][here] * len(phrases) + i)
        key, times = np.unique(np.concatenate(keys), return_counts=True)
        return key // max(1, len(phrases)), key % max(1, len(phrases)), times, lengths

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, length = np.zeros(len(phrases), np.int64), 0, 0
        for batch in batches:
            _, phrase, _, lengths = found(batch.column("tokens"))
            held += np.bincount(phrase, minlength=len(phrases))
            rows, length = rows + len(lengths), length + int(lengths.sum())
        yield pa.RecordBatch.from_arrays([pa.array([-1, -2, *range(len(phrases))], pa.int64()), pa.array([rows, length, *held.tolist()], pa.int64())], ["phrase", "n"])

    held = claims.select(tokens.alias("tokens")).mapInArrow(count, "phrase long, n long").groupBy("phrase").agg(F.sum("n").alias("n"))
    sums = {r.phrase: r.n for r in held.collect()}  # a number for each phrase of the block
    total, df = sums.get(-1, 0), np.array([sums.get(i, 0) for i in range(len(phrases))], float)
    average = (sums.get(-2, 0) / total if total else 0.0) or 1.0
    times = table.column("times").to_numpy().astype(float)
    of = code.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    idf = np.maximum(1e-6, np.log((total - df + 0.5) / (df + 0.5)))
    spread = spark.sparkContext.broadcast(Spread(of, question, times * idf[of], len(phrases)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, done = Best(len(names), limit), 0
        for batch in batches:
            ids = batch.column("claim_id").to_numpy(zero_copy_only=False)
            row, phrase, tf, lengths = found(batch.column("tokens"))
            value = weight(tf.astype(float), lengths[row].astype(float), average)
            for a, b in _runs(lengths, len(names)):
                x, y = np.searchsorted(row, [a, b])
                tile = np.zeros((b - a, len(names)))
                spread.value.add(row[x:y] - a, phrase[x:y], value[x:y], tile)
                tile = np.where(tile > 0, np.floor(tile * MICRO + 0.5), -np.inf)
                best.add_tile(tile, done + np.arange(a, b), ids[a:b])
            done += len(ids)
        yield from _sent(names, [kind], best.settle(), ["query_id", "bm25", "claim_id"])

    schema = f"query_id {asked.schema['query_id'].dataType.simpleString()}, bm25 double, claim_id string"
    return claims.select("claim_id", tokens.alias("tokens")).sortWithinPartitions("claim_id").mapInArrow(score, schema).select("query_id", "claim_id", "bm25")


def behind(claims: DataFrame, pages: DataFrame, asked: DataFrame, naming: DataFrame, limit: int, wanted: DataFrame) -> DataFrame:
    """query_id, claim_id, source_id, page_id, raw_score: each task's best claims of the sources behind pages that a question names.

    claims(source_id, claim_id, confidence_status, text) are scored by asked(query_id, term, weight): the base of the page and
    what the terms in the text add, one point at most, or the name's own ``instead`` where none occurs.  pages(source_id,
    pages, own, own_types) lists the pages behind each source with the terms that name them, struct (page_id, types, exact,
    titled) by id, and the claims of the source that a term names themselves, struct (claim_id, term): such a claim has its
    source for a page, of own_types, unless one behind it is worth more.  naming(query_id, term, base, titled_base, instead) says what naming a page by a term is worth; of a source's pages the
    one of the largest base counts, then of the largest id, and the largest ``instead``.  ``wanted`` has a row for each
    question with filters (want_source, want_type, want_confidence), null for any.
    """
    spark = claims.sparkSession
    filters = wanted.toArrow()
    names, kind, _ = _questions(filters)
    numbers = {x: i for i, x in enumerate(names.tolist())}
    terms, naming_rows = asked.select("query_id", "term", "weight").toArrow(), naming.toArrow()
    listed = sorted(set(terms.column("term").to_pylist()) | set(naming_rows.column("term").to_pylist()))
    number = {t: i for i, t in enumerate(listed)}
    of = lambda table, column, held: np.array([held[x] for x in table.column(column).to_pylist()], np.int64)
    micro = lambda table, column: np.round(table.column(column).to_numpy().astype(float) * MICRO)
    # a match counts one beside 1024 times its weight: so a match without weight is told from none
    bonus = Spread(of(terms, "term", number), of(terms, "query_id", numbers), micro(terms, "weight") * 1024 + 1, len(listed))
    key, asking = of(naming_rows, "term", number), of(naming_rows, "query_id", numbers)
    worth = [Spread(key, asking, micro(naming_rows, c), len(listed)) for c in ("base", "titled_base", "instead")]
    wants = {c: filters.column(c).to_numpy(zero_copy_only=False) if c in filters.column_names else None for c in ("want_source", "want_type", "want_confidence")}
    wants = {c: x if x is not None and any(v is not None for v in x) else None for c, x in wants.items()}
    searched = spark.sparkContext.broadcast(sorted(set(terms.column("term").to_pylist())))
    shared = spark.sparkContext.broadcast((names, number, bonus, worth, wants))

    def named(lists: list, number: dict, worth: list, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By source and question: base (-inf: not named), what counts where no term occurs, and the place of the page."""
        base, instead, page = np.full((len(lists), width), -np.inf), np.zeros((len(lists), width)), np.full((len(lists), width), -1)
        for spread, field in ((worth[1], "titled"), (worth[0], "exact")):
            source, place, term = [], [], []
            for s, held in enumerate(lists):
                for p, one in enumerate(held or ()):
                    ids = [number[t] for t in one[field] or () if t in number]
                    source += [s] * len(ids)
                    place += [p] * len(ids)
                    term += ids
            source, place, term = (np.array(x, np.int64) for x in (source, place, term))
            at, q, value = spread.over(term)
            cell, place_ = source[at] * width + q, place[at]
            flat, pages_ = base.reshape(-1), page.reshape(-1)
            better = (value > flat[cell]) | ((value == flat[cell]) & (place_ > pages_[cell]))
            order = np.flatnonzero(better)[np.lexsort((place_[better], value[better]))]
            flat[cell[order]], pages_[cell[order]] = value[order], place_[order]  # of one cell's the last, which is the best, stays
            at, q, value = worth[2].over(term)
            np.maximum.at(instead.reshape(-1), source[at] * width + q, value)
        return base, instead, page

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, number, bonus, worth, wants = shared.value
        made, words = _automaton(searched) if searched.value else (None, [])
        numbered = np.array([number[w] for w in words], np.int64)
        best, done = Best(len(names), limit), 0
        for batch in batches:
            ids = batch.column("claim_id").to_numpy(zero_copy_only=False)
            code = batch.column("source_id").dictionary_encode()
            sources, own = code.dictionary.to_pylist(), code.indices.to_numpy(zero_copy_only=False)
            first = np.unique(own, return_index=True)[1]
            lists = batch.column("pages").take(pa.array(first)).to_pylist()
            own_claims = []
            for held in batch.column("own").take(pa.array(first)).to_pylist():
                own_claims.append({})
                for one in held or ():
                    own_claims[-1].setdefault(one["claim_id"], []).append(one["term"])
            own_types = batch.column("own_types").take(pa.array(first)).to_pylist()
            status = batch.column("confidence_status").to_numpy(zero_copy_only=False)
            texts = batch.column("text").to_pylist()
            for a, b in _runs(ids, len(names)):
                here, mine = np.unique(own[a:b], return_inverse=True)
                base, instead, page = named([lists[s] for s in here], number, worth, len(names))
                base, instead, page = base[mine], instead[mine], page[mine]
                itself = [(i - a, number[t]) for i in range(a, b) if own_claims[own[i]] for t in own_claims[own[i]].get(ids[i], ()) if t in number]
                near = np.full(base.shape, -1.0)
                if itself:
                    row, term = np.array(itself, np.int64).T
                    at, q, value = worth[2].over(term)
                    np.maximum.at(near.reshape(-1), row[at] * len(names) + q, value)
                    at, q, value = worth[1].over(term)
                    np.maximum.at(base.reshape(-1), row[at] * len(names) + q, value)
                hits = [sorted({n for _, n in made.iter(t)}) if made and t and alive else [] for t, alive in zip(texts[a:b], (base > -np.inf).any(axis=1).tolist(), strict=True)]
                row = np.repeat(np.arange(b - a), [len(h) for h in hits])
                tile = np.zeros((b - a, len(names)))
                bonus.add(row, numbered[np.array([n for h in hits for n in h], np.int64)], None, tile)
                page[(near >= 0) & ((page < 0) | (tile > 0) | (near >= instead))] = -1
                tile = base + np.minimum(np.where(tile > 0, np.floor(tile / 1024), np.maximum(instead, near)), MOST * MICRO)
                if wants["want_source"] is not None:
                    tile[np.array([[w is not None and w != sources[s] for w in wants["want_source"]] for s in here], bool)[mine]] = -np.inf
                if wants["want_type"] is not None:
                    most = max([1, *(len(lists[s] or ()) for s in here)])
                    for value in {w for w in wants["want_type"] if w is not None}:
                        passes = np.zeros((len(here), most + 1), bool)  # the last place is the source's own, which is page -1
                        for i, s in enumerate(here):
                            held = [value in (one["types"] or ()) for one in lists[s] or ()]
                            passes[i, : len(held)], passes[i, -1] = held, value in (own_types[s] or ())
                        tile[~np.take_along_axis(passes[mine], page % (most + 1), axis=1) & (wants["want_type"] == value)] = -np.inf
                if wants["want_confidence"] is not None:
                    for value in {w for w in wants["want_confidence"] if w is not None}:
                        tile[np.ix_(status[a:b] != value, wants["want_confidence"] == value)] = -np.inf
                pages_ = np.empty(len(here), object)
                pages_[:] = [[*(one["page_id"] for one in lists[s] or ()), sources[s]] for s in here]  # page -1 is the source's
                best.add_tile(tile, done + np.arange(a, b), ids[a:b], np.array(sources, object)[own[a:b]], _Picked(pages_, mine, page))
            done += len(ids)
        yield from _sent(names, [kind], best.settle(), ["query_id", "raw_score", "claim_id", "source_id", "page_id"])

    schema = f"query_id {wanted.schema['query_id'].dataType.simpleString()}, raw_score double, claim_id string, source_id string, page_id string"
    rows = claims.select("source_id", "claim_id", "confidence_status", "text").join(pages, "source_id")
    return rows.sortWithinPartitions("claim_id").mapInArrow(score, schema).select("query_id", "claim_id", "source_id", "page_id", "raw_score")


class _Picked:
    """The page of each row and question, looked up for the few that are kept."""

    ndim = 2

    def __init__(self, pages: np.ndarray, source: np.ndarray, page: np.ndarray):
        self.pages, self.source, self.page = pages, source, page

    def __getitem__(self, at: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        out = np.empty(len(at[0]), object)
        out[:] = [self.pages[s][p] for s, p in zip(self.source[at[0]].tolist(), self.page[at].tolist(), strict=True)]
        return out
