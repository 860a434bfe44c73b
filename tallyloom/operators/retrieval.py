"""Search, hybrid similarity retrieval, relevance rules and evidence records."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..functions.numbers import number, unit
from ..sources.landing import settled
from .quantiles import exact_quantiles
from .windows import smoothed_overlap, tiered_order

WEIGHTS = {"text": 0.4, "visual": 0.4, "strategy": 0.2}
CONFLICT = 0.1
EMPTY = "cast(array() as array<string>)"


def library(df: DataFrame, lists: list[str], flags: list[str], numbers: list[str], defaults: dict[str, str]) -> DataFrame:
    """Every listed column present: lists never null, flags false, numbers coerced, others null of their type."""
    new = {}
    for c in lists:
        new[c] = F.coalesce(F.col(c), F.expr(EMPTY)) if c in df.columns else F.expr(EMPTY)
    for c in flags:
        new[c] = F.coalesce(F.col(c).cast("boolean"), F.lit(False)) if c in df.columns else F.lit(False)
    for c in numbers:
        new[c] = number(F.col(c).cast("string")) if c in df.columns else F.lit(None).cast("double")
    for c, kind in defaults.items():
        if c not in df.columns:
            new[c] = F.lit(None).cast(kind)
    return df.withColumns(new)


def search_text(df: DataFrame, texts: list[str], lists: list[str], tags: str = "hashtags") -> DataFrame:
    parts = [F.coalesce(F.col(c), F.lit("")) for c in texts]
    parts += [F.array_join(F.coalesce(F.col(c), F.expr(EMPTY)), " ") for c in lists]
    parts.append(F.array_join(F.transform(F.coalesce(F.col(tags), F.expr(EMPTY)), lambda t: F.concat(F.lit("#"), t)), " "))
    return df.withColumn("search_text", F.lower(F.concat_ws(" ", *parts)))


def facet(df: DataFrame, chosen: dict[str, list[str]]) -> Column:
    """OR inside a facet, AND across; an empty choice lets all pass."""
    out = F.lit(True)
    for col, values in chosen.items():
        if values:
            many = df.schema[col].dataType.typeName() == "array"
            out = out & (F.arrays_overlap(col, F.array(*map(F.lit, values))) if many else F.col(col).isin(values))
    return out


def search(df: DataFrame, query: str, chosen: dict[str, list[str]] | None = None, limit: int = 24, curated: Column | None = None) -> DataFrame:
    """Rows whose search text holds every word, in tiered order, with the total count.

    The count is an aggregate of its own, so the page is a top-k and not a global window.
    """
    hit = facet(df, chosen or {})
    for term in query.lower().split():
        hit = hit & F.contains("search_text", F.lit(term))
    found = df.where(hit)
    total = found.agg(F.count("*").alias("total"))
    page = found.orderBy(*tiered_order(found, curated if curated is not None else F.lit(False))).limit(limit)
    return page.crossJoin(F.broadcast(total))  # one row


def high_performers(df: DataFrame, value: str = "wer", q: float = 0.9, views: int = 100_000) -> DataFrame:
    cut = exact_quantiles(df, {}, {"_cut": (value, q)})
    return df.crossJoin(F.broadcast(cut)).where((F.col(value) >= F.col("_cut")) & (F.col("view_count") >= views)).drop("_cut")  # one row


#: Rows of a tile of the comparison: queries, candidates; and the queries that are compared at a time.
TILE_QUERIES, TILE_ROWS, AT_ONCE = 32_768, 65_536, 512


def similar(queries: DataFrame, pool: DataFrame, k: int = 6, key: str = "video_id", cells: int | None = None, block_rows: int | None = None) -> DataFrame:
    """The k most similar of the pool for each query, at most one per author.

    Both sides: key, author_id, text_vec, visual_vec (null if missing), strategy, categories
    (arrays).  A part that the query lacks is dropped without new weights; a candidate without
    the vector scores 0 there.  Equal scores: within an author the larger key, between authors
    the smaller.  Rows with a null key are left out.

    All pairs are compared, in tiles (see ``_by_tiles``).  ``cells`` asks for a ``SimilarityIndex`` instead, which
    is as exact and pays where vectors lie in groups.
    """
    if cells is not None:
        return SimilarityIndex(pool, key, cells, block_rows or 2_000).search(queries, k)
    return _by_tiles(queries, pool, k, key, min(TILE_QUERIES, block_rows or TILE_QUERIES), block_rows or TILE_ROWS)


def _by_tiles(queries: DataFrame, pool: DataFrame, k: int, key: str, q_rows: int, c_rows: int) -> DataFrame:
    """Parts of the queries times parts of the pool, a task a tile, at most k rows of it a query.

    An author's rows stand in one part of the pool, so its best row there is its best of all and the k-th author of
    a tile is a safe cut, ties included.  An author with more rows than an eighth of a part gets parts of its own,
    which give one row a query each.  What is shuffled grows with the number of tiles times their two sides.
    """
    spark, types = pool.sparkSession, {c: pool.schema[c].dataType.simpleString() for c in (key, "author_id")}
    q = settled(_compared_columns(queries, key))
    c = settled(_compared_columns(pool, key).withColumn("number", F.monotonically_increasing_id()))
    light = max(1, -(-c.count() // c_rows))
    large = c.groupBy("author_id").agg(F.count("*").alias("n")).where(F.col("n") > c_rows // 8).collect()  # at most eight a part
    own, parts = [], light
    for r in large:
        n = -(-r.n // c_rows)
        own.append((r.author_id, parts, n))
        parts += n
    own = F.broadcast(spark.createDataFrame(own, f"_a {types['author_id']}, _first int, _n int"))
    dealt = F.when(F.col("_first").isNull(), F.pmod(F.xxhash64("author_id"), F.lit(light))).otherwise(F.col("_first") + F.pmod(F.xxhash64("number"), F.col("_n")))
    c = c.join(own, F.col("author_id").eqNullSafe(F.col("_a")), "left").withColumn("c_part", dealt.cast("int")).drop("_a", "_first", "_n", "number")
    q_parts = max(1, -(-q.count() // q_rows))
    q = q.withColumns({"q_part": F.pmod(F.xxhash64("text", "visual", "strategy", "categories"), F.lit(q_parts)).cast("int"), "c_part": F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))})
    c = c.withColumn("q_part", F.explode(F.sequence(F.lit(0), F.lit(q_parts - 1))))
    schema = f"q_id {queries.schema[key].dataType.simpleString()}, c_id {types[key]}, author_id {types['author_id']}, score double, text_sim double, visual_sim double, overlap double, category_conflict boolean"
    found = q.groupBy("q_part", "c_part").cogroup(c.groupBy("q_part", "c_part")).applyInPandas(lambda a, b: _best_of_tile(a, b, k), schema)
    return _first_k(found, k, key)


def _first_k(found: DataFrame, k: int, key: str) -> DataFrame:
    """Of each query the best row of every author, and of these the first k."""
    top = F.max(F.struct("score", F.struct("c_id", "text_sim", "visual_sim", "overlap", "category_conflict").alias("r")))
    best = found.groupBy("q_id", "author_id").agg(top.alias("t")).select("q_id", "author_id", "t.score", "t.r.*")
    rank = F.row_number().over(Window.partitionBy("q_id").orderBy(F.desc("score"), "c_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).withColumnsRenamed({"q_id": "query_id", "c_id": key})


def _compared_columns(df: DataFrame, key: str) -> DataFrame:
    """The columns that are compared; vectors keep their type and are null where they have no direction."""
    empty = F.expr(EMPTY)
    vector = lambda c: F.when(unit(F.col(c)).isNotNull(), F.col(c))
    return df.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), "author_id", vector("text_vec").alias("text"), vector("visual_vec").alias("visual"), F.array_sort(F.array_distinct(F.coalesce("strategy", empty))).alias("strategy"), F.array_sort(F.array_distinct(F.coalesce("categories", empty))).alias("categories"))


def _units(vectors: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Vectors at length 1 as rows, zeros where there is none, and which ones there are."""
    have = vectors.notna().to_numpy()
    if not have.any():
        return np.zeros((len(have), 0)), have
    known = np.stack(vectors[have].to_list()).astype(float)
    out = np.zeros((len(have), known.shape[1]))
    out[have] = known / np.sqrt((known * known).sum(1))[:, None]
    return out, have


def _signatures(df: pd.DataFrame) -> tuple[np.ndarray, list[tuple[frozenset, frozenset]]]:
    """Each row's number of its labels, and the distinct (strategy, categories)."""
    found: dict[tuple, int] = {}
    at = np.array([found.setdefault((tuple(s), tuple(c)), len(found)) for s, c in zip(df["strategy"], df["categories"], strict=True)], np.int64)
    return at, [(frozenset(s), frozenset(c)) for s, c in found]


def _label_parts(a: tuple[frozenset, frozenset], b: tuple[frozenset, frozenset]) -> tuple[float, bool]:
    """Overlap of the strategies (NaN where the first has none) and whether the categories conflict."""
    both = len(a[0] & b[0])
    return both / (len(a[0]) + len(b[0]) - both + 1) if a[0] else np.nan, bool(a[1]) and bool(b[1]) and not a[1] & b[1]


class _Labels:
    """What labels add to the score, for some signatures of the candidates (flags of labels as a matrix)."""

    def __init__(self, held: list[tuple[frozenset, frozenset]]):
        self.codes = [{x: i for i, x in enumerate(dict.fromkeys(x for s in held for x in s[side]))} for side in (0, 1)]
        self.flags = [self._flags(held, side) for side in (0, 1)]
        self.sizes = [np.array([len(s[side]) for s in held], np.float32) for side in (0, 1)]

    def _flags(self, held: list[tuple[frozenset, frozenset]], side: int) -> np.ndarray:
        out = np.zeros((len(held), len(self.codes[side])), np.float32)
        for i, s in enumerate(held):
            out[i, [self.codes[side][x] for x in s[side] if x in self.codes[side]]] = 1
        return out

    def added(self, asked: list[tuple[frozenset, frozenset]]) -> np.ndarray:
        sizes = [np.array([len(s[side]) for s in asked], np.float32) for side in (0, 1)]
        both = [self._flags(asked, side) @ self.flags[side].T for side in (0, 1)]
        overlap = both[0] / (sizes[0][:, None] + self.sizes[0][None, :] - both[0] + 1)
        conflict = (sizes[1][:, None] > 0) & (self.sizes[1][None, :] > 0) & (both[1] == 0)
        return (WEIGHTS["strategy"] * overlap - CONFLICT * conflict).astype(np.float32)


def _tighten(best: np.ndarray, i: np.ndarray, author: np.ndarray, score: np.ndarray) -> None:
    """``best``: the k largest authors' scores of each query so far; authors are new to it."""
    order = np.lexsort((-score, author, i))
    i, author, score = i[order], author[order], score[order]
    first = np.ones(len(i), bool)
    first[1:] = (i[1:] != i[:-1]) | (author[1:] != author[:-1])
    i, score = i[first], score[first]
    k, rows = best.shape[1], np.unique(i)
    i, score = np.concatenate([np.repeat(rows, k), i]), np.concatenate([best[rows].ravel(), score])
    order = np.lexsort((-score, i))
    i, score = i[order], score[order]
    starts = np.searchsorted(i, rows)
    best[rows] = score[starts[:, None] + np.arange(k)[None, :]]


def _best_of_tile(q: pd.DataFrame, c: pd.DataFrame, k: int) -> pd.DataFrame:
    """The first k of a tile's authors for each query, by their best rows.

    Queries alike in vectors and labels are compared once, and for one author more than asked for: a query leaves
    out its own row, which changes the place of one author only.  Products in single precision leave out what
    can't be among them, beyond the largest error that they can have; what is left is scored in double precision.
    """
    columns = ["q_id", "c_id", "author_id", "score", "text_sim", "visual_sim", "overlap", "category_conflict"]
    q = q[q["text"].notna() | q["visual"].notna() | (q["strategy"].map(len) > 0)].reset_index(drop=True)  # a query without any part finds nothing
    if q.empty or c.empty:
        return pd.DataFrame(columns=columns)
    author = c["author_id"].astype(object).where(c["author_id"].notna(), None)
    code = pd.factorize(author, use_na_sentinel=False)[0]
    order = np.argsort(code, kind="stable")
    c, code, author = c.iloc[order].reset_index(drop=True), code[order], author.to_numpy()[order]
    place = pd.factorize(c["id"], sort=True)[0]
    sig_q, asked = _signatures(q)
    sig_c, held = _signatures(c)
    raw = lambda v: None if v is None else v.tobytes()
    classes: dict[tuple, int] = {}
    at_class = np.array([classes.setdefault((raw(t), raw(v), s), len(classes)) for t, v, s in zip(q["text"], q["visual"], sig_q, strict=True)])
    one = np.unique(at_class, return_index=True)[1]
    sig_q, one = sig_q[one], q.iloc[one]
    vectors = {n: (_units(one[n]), _units(c[n])) for n in ("text", "visual")}
    usable = [n for n, ((a, _), (b, _)) in vectors.items() if a.shape[1] and b.shape[1]]
    left, right = (np.hstack([np.zeros((len(d), 0)), *[vectors[n][side][0] * (1 if side else WEIGHTS[n]) for n in usable]]).astype(np.float32) for side, d in ((0, one), (1, c)))
    slack = 2 * (left.shape[1] + 16) * 6e-8 + 1e-8
    starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])  # an author's rows are never cut
    firsts = starts[np.unique(np.searchsorted(starts, np.arange(0, len(c), 8_192)).clip(max=len(starts) - 1))]
    blocks = []
    for a, b in zip(firsts, [*firsts[1:], len(c)], strict=True):
        here, at_c = np.unique(sig_c[a:b], return_inverse=True)
        blocks.append((a, b, _Labels([held[s] for s in here]), at_c, starts[(starts >= a) & (starts < b)] - a))
    found = []
    for x in range(0, len(one), AT_ONCE):
        y, hits = min(x + AT_ONCE, len(one)), []
        best = np.full((y - x, k + 1), -np.inf, np.float32)
        wanted, at_q = np.unique(sig_q[x:y], return_inverse=True)
        for a, b, labels, at_c, heads in blocks:
            s = left[x:y] @ right[a:b].T
            s += labels.added([asked[w] for w in wanted])[:, at_c][at_q]
            if a == 0:
                most = np.maximum.reduceat(s, heads, axis=1)
                n = min(k + 1, most.shape[1])
                best[:, :n] = -np.sort(np.partition(-most, n - 1, axis=1)[:, :n], axis=1)
            at = np.flatnonzero(s >= best[:, -1:] - slack)
            i, j = at // (b - a), at % (b - a) + a
            score = s.ravel()[at]
            hits.append((i, j, score))
            if a and len(i):
                _tighten(best, i, code[j], score)
        i, j, score = (np.concatenate([h[n] for h in hits]) for n in range(3))
        keep = score >= best[i, -1] - slack
        found.append(_first_authors(_scored(i[keep] + x, j[keep], vectors, usable, sig_q, sig_c, asked, held), code, place, k))
    rows, others = (pd.concat(part) for part in zip(*found, strict=True))
    # the class's first authors, and where the query's own row is among the hits, its author's rows
    mine = pd.DataFrame({"q": np.arange(len(q)), "class": at_class, "id": q["id"]})
    own = mine.merge(pd.DataFrame({"id": c["id"], "own_j": np.arange(len(c)), "author": code}), on="id")
    table = pd.concat([mine[["q", "class"]].merge(rows, on="class"), own[["q", "class", "author"]].merge(others, on=["class", "author"])])
    table = table[q["id"].to_numpy()[table["q"]] != c["id"].to_numpy()[table["j"]]]
    # an author's best, the larger key among equals; then the first k authors, the smaller key among equals
    table = table.sort_values(["q", "author", "score", "place"], ascending=[True, True, False, False]).drop_duplicates(["q", "author"])
    table = table.sort_values(["q", "score", "place"], ascending=[True, False, True]).groupby("q").head(k)
    j, none = table["j"].to_numpy(), lambda x: x.astype(object).where(x.notna(), None).to_numpy()
    return pd.DataFrame({"q_id": q["id"].to_numpy()[table["q"]], "c_id": c["id"].to_numpy()[j], "author_id": author[j], "score": table["score"].to_numpy(), "text_sim": none(table["text"]), "visual_sim": none(table["visual"]), "overlap": none(table["overlap"]), "category_conflict": table["conflict"].to_numpy(bool)}, columns=columns)


def _scored(i: np.ndarray, j: np.ndarray, vectors: dict, usable: list[str], sig_q: np.ndarray, sig_c: np.ndarray, asked: list, held: list) -> pd.DataFrame:
    """Score and its parts of the pairs (i, j), in double precision."""
    out = {}
    for name, ((x, have), (y, known)) in vectors.items():
        dots = np.concatenate([np.zeros(0), *[np.einsum("ij,ij->i", x[i[n : n + 8_192]], y[j[n : n + 8_192]]) for n in range(0, len(i), 8_192)]]) if name in usable else np.zeros(len(i))
        out[name] = np.where(have[i], np.where(known[j], dots, 0.0), np.nan)
    pairs, at = np.unique(sig_q[i] * len(held) + sig_c[j], return_inverse=True)
    parts = [_label_parts(asked[p // len(held)], held[p % len(held)]) for p in pairs]
    out["overlap"], out["conflict"] = np.array([p[0] for p in parts], float)[at], np.array([p[1] for p in parts], bool)[at]
    score = np.nan_to_num(out["text"]) * WEIGHTS["text"] + np.nan_to_num(out["visual"]) * WEIGHTS["visual"] + np.nan_to_num(out["overlap"]) * WEIGHTS["strategy"] - CONFLICT * out["conflict"]
    return pd.DataFrame({"class": i, "j": j, "score": np.round(score, 9) + 0.0, **out})  # equal up to rounding is a tie


def _first_authors(rows: pd.DataFrame, code: np.ndarray, place: np.ndarray, k: int) -> tuple[pd.DataFrame, pd.DataFrame]:
    """The two best rows (of different keys) of each class's first k + 1 authors, and of all its authors."""
    i, j, score = (rows[n].to_numpy() for n in ("class", "j", "score"))
    order = np.lexsort((-place[j], -score, code[j], i))
    i, author, key = i[order], code[j][order], place[j][order]
    new = np.r_[True, (i[1:] != i[:-1]) | (author[1:] != author[:-1])][: len(i)]
    other = new | np.r_[True, key[1:] != key[:-1]][: len(i)]
    number = np.cumsum(other)
    nth = number - np.repeat(number[new], np.diff(np.r_[np.flatnonzero(new), len(i)]))
    order = order[other & (nth < 2)]
    rows = rows.iloc[order].assign(author=code[j[order]], place=place[j[order]])
    heads = rows.drop_duplicates(["class", "author"]).sort_values(["class", "score", "place"], ascending=[True, False, True]).groupby("class").head(k + 1)
    return rows.merge(heads[["class", "author"]], on=["class", "author"]), rows


class SimilarityIndex:
    """An inverted file of the pool: cells around centres, with a bound on what any row of a cell can score.

    Centres are up to ``cells`` of the pool's distinct vectors, chosen by hash; every row goes to the
    nearest one.  A cell keeps the widest angle between its centre and its rows, by vector, the bits of
    its labels' hashes and its fewest labels: from these follows an upper bound of a query's score in
    the cell.  A search first visits the cells with the highest bounds, until they hold 16 k rows, and
    then only cells whose bound reaches the k-th best author found, so the result is exact.

    A cell with more than ``block_rows`` rows (one vector may stand in a third of all rows) is cut
    into parts by row number, and so are the queries; a task compares one part with one of them.  What
    is broadcast is bounded by ``cells``.
    """

    def __init__(self, pool: DataFrame, key: str = "video_id", cells: int = 4_096, block_rows: int = 2_000):
        self.key, self.block_rows, self.types = key, block_rows, {c: pool.schema[c].dataType.simpleString() for c in (key, "author_id")}
        rows = _prepared(pool, key)
        marks = rows.select("mark").distinct().orderBy("mark").limit(cells).agg(F.max("mark")).first()[0]
        centres = [] if marks is None else rows.where(F.col("mark") <= marks).dropDuplicates(["mark"]).orderBy("mark").select("text", "visual").collect()  # at most ``cells`` rows
        self.shared = pool.sparkSession.sparkContext.broadcast((_matrix([r.text for r in centres]), _matrix([r.visual for r in centres])))
        angles = "cell int, text_cos double, visual_cos double"
        kept = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "mark"]
        self.rows = settled(rows.drop("mark").mapInPandas(_nearest(self.shared), ", ".join([*kept, angles])))
        bits = F.aggregate("bits", F.lit(0).cast("long"), lambda m, b: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), b)))
        cell = self.rows.groupBy("cell").agg(F.count("*").alias("n"), F.min("text_cos").alias("text_cos"), F.min("visual_cos").alias("visual_cos"), F.count("text").alias("texts"), F.count("visual").alias("visuals"), F.bit_or(bits).alias("labels"), F.min(F.size("bits")).alias("fewest"))
        self.cells = cell.orderBy("cell").toPandas()  # at most ``cells`` rows
        self.bounds = pool.sparkSession.sparkContext.broadcast(self.cells)
        self.parts = {int(c): -(-int(n) // block_rows) for c, n in zip(self.cells["cell"], self.cells["n"], strict=True)}

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        q = self._numbered(queries)
        first = settled(self._compared(q, self.visits(q, k), k))
        one = first.groupBy("q_no", "author_id").agg(F.max("score").alias("score"))
        rank = F.row_number().over(Window.partitionBy("q_no").orderBy(F.desc("score")))
        reached = one.withColumn("r", rank).where(F.col("r") == k).select("q_no", F.col("score").alias("least"))
        second = self._compared(q, self.visits(q.join(reached, "q_no", "left"), k), k)
        return _first_k(first.unionByName(second), k, self.key)

    def _numbered(self, queries: DataFrame) -> DataFrame:
        return settled(_prepared(queries, self.key).drop("mark").withColumn("q_no", F.monotonically_increasing_id()))

    def visits(self, queries: DataFrame, k: int) -> DataFrame:
        """(q_no, cell): without a column ``least`` the first cells of each query; with it the others whose bound
        reaches it (all others where it is null)."""
        shared, cells, later = self.shared, self.bounds, "least" in queries.columns

        def chosen(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            rows = cells.value["n"].to_numpy()
            for frame in frames:
                for i in range(0, len(frame), 256):
                    q = frame.iloc[i : i + 256]
                    bound = _upper_bounds(q, shared.value, cells.value) if len(rows) else np.zeros((len(q), 0))
                    order = np.argsort(-bound, axis=1, kind="stable")
                    before = np.cumsum(rows[order], axis=1) - rows[order]
                    take = np.zeros_like(bound, bool)
                    np.put_along_axis(take, order, before < 16 * k, axis=1)
                    if later:
                        take = ~take & (bound + 1e-6 >= q["least"].fillna(-np.inf).to_numpy()[:, None])
                    at_q, at_c = np.nonzero(take)
                    yield pd.DataFrame({"q_no": q["q_no"].to_numpy()[at_q], "cell": cells.value["cell"].to_numpy()[at_c]})

        return queries.select("q_no", "text", "visual", "bits", *(["least"] if later else [])).mapInPandas(chosen, "q_no long, cell int")

    def _compared(self, queries: DataFrame, visits: DataFrame, k: int) -> DataFrame:
        """The best candidates of the visited cells.  Cell parts are dealt to shards of about ``block_rows`` rows, and a
        task compares a shard with a part of the queries, cell by cell as they visit them."""
        spark, shards = queries.sparkSession, max(1, -(-int(self.cells["n"].sum()) // self.block_rows))
        q_part = F.pmod(F.xxhash64("q_no"), F.lit(max(1, -(-queries.count() // self.block_rows)))).cast("int")
        cut = F.broadcast(spark.createDataFrame(list(self.parts.items()), "cell int, parts int"))  # at most ``cells`` rows
        shard = F.pmod(F.xxhash64("cell", "part"), F.lit(shards)).cast("int").alias("shard")
        pairs = visits.join(cut, "cell").select("q_no", "cell", q_part.alias("q_part"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        pairs = settled(pairs.groupBy("q_no", "q_part", shard).agg(F.collect_list(F.struct("cell", "part")).alias("cells")))
        q = pairs.join(queries.drop("bits"), "q_no")
        visited = pairs.select(F.col("shard").alias("shard"), F.col("q_part").alias("q_part")).distinct()
        rows = self.rows.join(cut, "cell").withColumn("part", F.pmod(F.xxhash64("number"), F.col("parts")).cast("int"))
        c = rows.select(shard, "cell", "part", "id", "author_id", "text", "visual", "strategy", "categories").join(visited, "shard")
        schema = f"q_no long, q_id {queries.schema['id'].dataType.simpleString()}, c_id {self.types[self.key]}, author_id {self.types['author_id']}, score double, text_sim double, visual_sim double, overlap double, category_conflict boolean"
        return q.groupBy("shard", "q_part").cogroup(c.groupBy("shard", "q_part")).applyInPandas(lambda a, b: _best_of_shard(a, b, k), schema)


def _prepared(df: DataFrame, key: str) -> DataFrame:
    """The columns that are compared, the vectors' hash and the rows' number, settled."""
    empty = F.expr(EMPTY)
    strategy = F.array_distinct(F.coalesce("strategy", empty))
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), "author_id", unit(F.col("text_vec")).alias("text"), unit(F.col("visual_vec")).alias("visual"), strategy.alias("strategy"), F.coalesce("categories", empty).alias("categories"))
    bits = F.transform("strategy", lambda x: F.pmod(F.xxhash64(x), F.lit(64)).cast("int"))
    return settled(rows.withColumns({"bits": bits, "mark": F.xxhash64("text", "visual"), "number": F.monotonically_increasing_id()}))


def _matrix(vectors: list | pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows, zeros where there is none, and which ones there are."""
    have = np.array([v is not None for v in vectors], bool)
    width = next((len(v) for v in vectors if v is not None), 0)
    out = np.zeros((len(have), width))
    for i in np.flatnonzero(have):
        out[i] = vectors[i] if isinstance(vectors, list) else vectors.iloc[i]
    return out, have


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a @ b.T if a.shape[1] and b.shape[1] else np.zeros((len(a), len(b)))


def _nearest(shared) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Adds the nearest centre to each row and the cosines to it (null for a vector that the row or centre lacks)."""

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centres = shared.value
        for frame in frames:
            for i in range(0, len(frame), 512):
                rows = frame.iloc[i : i + 512].copy()
                sides = [_matrix(rows["text"]), _matrix(rows["visual"])]
                cosines = [_products(x, c) for (x, _), (c, _) in zip(sides, centres, strict=True)]
                cell = (cosines[0] + cosines[1]).argmax(1)
                rows["cell"] = cell.astype(np.int32)
                for name, cosine, (_, have), (_, known) in zip(("text_cos", "visual_cos"), cosines, sides, centres, strict=True):
                    rows[name] = np.where(have & known[cell], cosine[np.arange(len(cell)), cell], np.where(have, -1.0, np.nan))
                yield rows

    return assign


def _upper_bounds(q: pd.DataFrame, centres: tuple, cells: pd.DataFrame) -> np.ndarray:
    """What a row of each cell can score at most, for each query: by the angle that is left between the query and the
    cell's rows, and by the query's labels whose bits the cell has."""
    at = cells["cell"].to_numpy()
    total = np.zeros((len(q), len(at)))
    for name, (centre, known) in zip(("text", "visual"), centres, strict=True):
        x, have = _matrix(q[name])
        count, least = cells[f"{name}s"].to_numpy(), cells[f"{name}_cos"].to_numpy(float)
        away = np.where(known[at], np.arccos(np.clip(np.nan_to_num(least, nan=1.0), -1, 1)), np.pi)
        bound = np.cos(np.maximum(0, np.arccos(np.clip(_products(x, centre[at]), -1, 1)) - away[None, :]))
        bound = np.where(count[None, :] == 0, 0.0, np.where(count[None, :] < cells["n"].to_numpy()[None, :], np.maximum(bound, 0), bound))
        total += WEIGHTS[name] * np.where(have[:, None], bound, 0)
    counts = np.zeros((len(q), 64))
    for i, bits in enumerate(q["bits"]):
        np.add.at(counts[i], np.asarray(bits, int), 1)
    labels = cells["labels"].to_numpy(np.int64).view(np.uint64)
    held = (labels[:, None] >> np.arange(64, dtype=np.uint64)[None, :]) & np.uint64(1)
    size = counts.sum(1)
    return total + WEIGHTS["strategy"] * (counts @ held.T.astype(float)) / (np.maximum(size[:, None], cells["fewest"].to_numpy()[None, :]) + 1)


def _flags(labels: list, codes: dict) -> np.ndarray:
    """Rows x labels: which labels each row has."""
    out = np.zeros((len(labels), len(codes)), bool)
    for i, names in enumerate(labels):
        out[i, [codes[x] for x in names]] = True
    return out


class _Side:
    """Vectors and label flags of one side of a comparison; labels are numbered alike on both sides."""

    def __init__(self, df: pd.DataFrame, codes: dict[str, dict]):
        self.vectors = {n: _matrix(df[n]) for n in ("text", "visual")}
        self.flags = {n: _flags(df[n].to_list(), codes[n]) for n in ("strategy", "categories")}
        self.sizes = {n: f.sum(1) for n, f in self.flags.items()}


def _scores(q: _Side, c: _Side, i: np.ndarray, j: np.ndarray) -> dict[str, np.ndarray]:
    """Score and its parts of the pairs (i, j); a part that the query lacks is NaN, and so is a score without any part."""
    out = {}
    for name in ("text", "visual"):
        (x, have), (y, known) = q.vectors[name], c.vectors[name]
        dots = np.einsum("ij,ij->i", x[i], y[j]) if x.shape[1] and y.shape[1] else np.zeros(len(i))
        out[name] = np.where(have[i], np.where(known[j], dots, 0.0), np.nan)
    both = {n: (q.flags[n][i] & c.flags[n][j]).sum(1) for n in ("strategy", "categories")}
    nq, nc = q.sizes["strategy"][i], c.sizes["strategy"][j]
    out["overlap"] = np.where(nq > 0, both["strategy"] / (nq + nc - both["strategy"] + 1), np.nan)
    out["conflict"] = (q.sizes["categories"][i] > 0) & (c.sizes["categories"][j] > 0) & (both["categories"] == 0)
    score = np.nan_to_num(out["text"]) * WEIGHTS["text"] + np.nan_to_num(out["visual"]) * WEIGHTS["visual"] + np.nan_to_num(out["overlap"]) * WEIGHTS["strategy"] - CONFLICT * out["conflict"]
    score = np.round(score, 9) + 0.0  # equal up to rounding is a tie
    out["score"] = np.where(np.isnan(out["text"]) & np.isnan(out["visual"]) & np.isnan(out["overlap"]), np.nan, score)
    return out


def _best_of_shard(q: pd.DataFrame, c: pd.DataFrame, k: int) -> pd.DataFrame:
    """Of each query's visited cells the best candidate of every author that reaches the query's k-th best author."""
    columns = ["q_no", "q_id", "c_id", "author_id", "score", "text_sim", "visual_sim", "overlap", "category_conflict"]
    if q.empty or c.empty:
        return pd.DataFrame(columns=columns)
    q, c = q.sort_values("q_no").reset_index(drop=True), c.sort_values(["cell", "part"]).reset_index(drop=True)
    codes = {n: {x: i for i, x in enumerate(dict.fromkeys(x for side in (q, c) for names in side[n] for x in names))} for n in ("strategy", "categories")}
    sides = _Side(q, codes), _Side(c, codes)
    author = c["author_id"].astype(object).where(c["author_id"].notna(), None)
    code, order = pd.factorize(author, use_na_sentinel=False)[0], pd.factorize(c["id"], sort=True)[0]
    at = {key: (rows.min(), rows.max() + 1) for key, rows in c.groupby(["cell", "part"]).indices.items()}
    ids_q, ids_c = q["id"].to_numpy(), c["id"].to_numpy()
    width = max(64, *(len(x) for x in codes.values()), *(m.shape[1] for m, _ in sides[1].vectors.values()))
    found, held, pairs = [], [], 0

    def flush() -> None:
        nonlocal pairs
        if not held:
            return
        i = np.repeat([x for x, _, _ in held], [b - a for _, a, b in held])
        j = np.concatenate([np.arange(a, b) for _, a, b in held])
        held.clear()
        pairs = 0
        other = ids_q[i] != ids_c[j]
        i, j = i[other], j[other]
        parts = _scores(*sides, i, j)
        table = pd.DataFrame({"i": i, "j": j, "author": code[j], "order": order[j], **parts}).dropna(subset=["score"])
        # an author's best, the larger key among equals; then the authors down to the k-th, ties included
        table = table.sort_values(["i", "author", "score", "order"], ascending=[True, True, False, False]).drop_duplicates(["i", "author"])
        found.append(table[table.groupby("i")["score"].rank(method="min", ascending=False) <= k])

    for n, cells in enumerate(q["cells"]):
        for cell in cells:
            if (span := at.get((cell["cell"], cell["part"]))) is not None:
                held.append((n, *span))
                pairs += span[1] - span[0]
        if pairs * width > 8_000_000:
            flush()  # a query's visits are never split, so its k-th best is that of all of them
    flush()
    if not found:
        return pd.DataFrame(columns=columns)
    best = pd.concat(found)
    i, j, none = best["i"].to_numpy(), best["j"].to_numpy(), lambda x: x.astype(object).where(x.notna(), None).to_numpy()
    return pd.DataFrame({"q_no": q["q_no"].to_numpy()[i], "q_id": ids_q[i], "c_id": ids_c[j], "author_id": author.to_numpy()[j], "score": best["score"].to_numpy(), "text_sim": none(best["text"]), "visual_sim": none(best["visual"]), "overlap": none(best["overlap"]), "category_conflict": best["conflict"].to_numpy()}, columns=columns)


def shared_labels(pairs: list[tuple[str, str]], limit: int = 4) -> Column:
    """Labels that two rows share, in order of specificity of the columns, distinct."""
    return F.slice(F.array_distinct(F.flatten(F.array(*[F.array_intersect(F.coalesce(F.col(a), F.expr(EMPTY)), F.coalesce(F.col(b), F.expr(EMPTY))) for a, b in pairs]))), 1, limit)


ANCHORS = ["subject_product", "narrative_intent"]


def aligned_dimensions(text_sim: Column, visual_sim: Column, same_product: Column, shared_type: Column, shared_strategy: Column, same_format: Column, visual_known: Column) -> Column:
    """The aligned ones of four dimensions, by fixed thresholds; the visual one only with evidence on both sides."""
    t, v = F.coalesce(text_sim, F.lit(0.0)), F.coalesce(visual_sim, F.lit(0.0))
    dims = {
        "subject_product": same_product & (t >= 0.40),
        "narrative_intent": (t >= 0.55) | (shared_type & (t >= 0.40)),
        "visual_presentation": ((v >= 0.75) | same_format) & visual_known,
        "creative_strategy": shared_strategy,
    }
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in dims.items()]))


def is_relevant(dims: Column) -> Column:
    return (F.size(dims) >= 2) & F.arrays_overlap(dims, F.array(*map(F.lit, ANCHORS)))


def assess(ranked: DataFrame, k: int, least: int = 2, key: str = "video_id") -> DataFrame:
    """Per query: the first k relevant in rank order, the excluded before the k-th, and whether a pattern may be stated.

    ranked: query_id, rank, key, relevant; lists are as short as the retrieval depth.
    """
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.col("relevant").cast("int")).over(w), F.lit(0))
    rows = ranked.withColumn("_before", before).where(F.col("_before") < k)
    picks = F.transform(F.array_sort(F.collect_list(F.when(F.col("relevant"), F.struct("rank", key)))), lambda x: x[key])
    out = rows.groupBy("query_id").agg(picks.alias("picks"), F.sum((~F.col("relevant")).cast("long")).alias("excluded"))
    return out.withColumns({"relevant": F.size("picks").cast("long"), "pattern_allowed": F.size("picks") >= least})


def evidence(queries: DataFrame, ranked: DataFrame, key: str = "video_id", columns: list[str] = ()) -> DataFrame:
    """One JSON record per query with its comparables in rank order."""
    child = F.struct("rank", F.col(key).alias("id"), *columns)
    listed = ranked.groupBy("query_id").agg(F.array_sort(F.collect_list(child)).alias("comparables"))
    rows = queries.join(listed, queries[key] == listed["query_id"], "left")
    body = F.struct(*[c for c in queries.columns], F.coalesce("comparables", F.array().cast(listed.schema["comparables"].dataType)).alias("comparables"))
    return rows.select(F.col(key), F.to_json(body).alias("record"))


def coverage_profile(df: DataFrame, columns: list[str], least: int = 1) -> DataFrame:
    """Uses of each label in a set, and whether it is a gap."""
    long = [df.select(F.lit(c).alias("facet"), F.explode(c).alias("label") if df.schema[c].dataType.typeName() == "array" else F.col(c).alias("label")) for c in columns]
    counts = reduce(DataFrame.unionByName, long).where("label is not null").groupBy("facet", "label").agg(F.count("*").alias("n"))
    return counts.withColumn("is_gap", F.col("n") < least)


#: Claim families of the text guard.
GUARDS = {
    "causal": r"\b(?:because of|caused by|drives?|leads? to|results? in)\b",
    "retrieval": r"\b(?:similarity score|embedding|cosine|retriev\w+)\b",
    "interpretive": r"\b(?:clearly|obviously|proves?|demonstrates? that)\b",
    "speculative": r"\b(?:might|may have|probably|perhaps|possibly)\b",
    "population": r"\b(?:all users|everyone|audiences? always|most people)\b",
    "cross_brand": r"\b(?:outperforms?|better than|versus)\b",
    "uncaptured": r"\b(?:music|voice-?over|soundtrack|narrator)\b",
}


def guard_flags(text: Column, families: dict[str, str] = GUARDS) -> dict[str, Column]:
    """problems (families that match) and first_hit (what the first of them matched)."""
    low = F.lower(F.coalesce(text, F.lit("")))
    problems = F.array_compact(F.array(*[F.when(low.rlike(p), F.lit(n)) for n, p in families.items()]))
    hit = F.lit(None).cast("string")
    for p in reversed(families.values()):
        hit = F.when(low.rlike(p), F.regexp_extract(low, f"({p})", 1)).otherwise(hit)
    return {"problems": problems, "first_hit": hit}


def record_issues(checks: dict[str, Column]) -> Column:
    """Names of the checks that fail (a null check fails)."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items()]))


def card(df: DataFrame, key: str, value: str, columns: list[str]) -> DataFrame:
    """One row by id as a struct of the listed columns."""
    return df.where(F.col(key) == value).select(key, F.to_json(F.struct(*columns)).alias("card"))


def leaf_paths(df: DataFrame) -> Column:
    """Paths of the leaves of a row that aren't null or empty, read off the schema."""

    def walk(schema: T.StructType, prefix: str):
        for f in schema.fields:
            path = f"{prefix}{f.name}"
            if isinstance(f.dataType, T.StructType):
                yield from walk(f.dataType, f"{path}.")
            else:
                c = F.col(path)
                full = F.size(c) > 0 if isinstance(f.dataType, T.ArrayType) else F.trim(c) != "" if isinstance(f.dataType, T.StringType) else c.isNotNull()
                yield F.when(F.coalesce(full, F.lit(False)), F.lit(path))

    return F.array_compact(F.array(*walk(df.schema, "")))


def unshared_citations(df: DataFrame, own: str, peers: str, key: str) -> DataFrame:
    """(key, peer, cited): cited labels of a record that a cited peer doesn't have.  peers: array of (id, labels)."""
    rows = df.select(key, F.col(own).alias("_own"), F.explode(peers).alias("p"))
    return rows.select(key, F.col("p.id").alias("peer"), F.explode(F.array_except("_own", F.coalesce("p.labels", F.expr(EMPTY)))).alias("cited"))


def highlight(text: Column, term: str) -> Column:
    return F.when(F.contains(F.lower(text), F.lit(term.lower())), tx.squeeze(text))
