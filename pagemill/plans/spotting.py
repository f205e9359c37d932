"""Word spotting: which words recur within a page and across pages.

Every candidate of a page is compared with every candidate of the other page,
because a match is judged against the background of all comparisons. Candidates
are put into blocks, one row for each, and pairs of blocks are compared as
matrices; what leaves a block pair is one row for each pair of tokens. So the
product of candidates never becomes rows, a block pair has a fixed size, and
block pairs spread over all tasks. Partitions of blocks meet where they are
read, so disk grows with the rows, not with the blocks that each one meets. The
mix of components needs their moments over a whole comparison: sums of each page
give those of cosines, a first pass over the block pairs those of distances.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields, replace
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagemill.functions import vectors as V
from pagemill.kernels import pairs as K
from pagemill.operators import aggregates as A
from pagemill.operators import joins as J
from pagemill.storage import small, stored

#: Candidates in a block.
BLOCK = 512
#: Blocks of either side that a task of comparisons has, at most on average.
CELL_BLOCKS = 16
#: Blocks that a task of gold_ranks keeps of one side, on average, where a page has no more, and that it takes of the other.
KEPT_BLOCKS, TAKEN_BLOCKS = 256, 64
#: Pages whose few numbers are broadcast.
BROADCAST_PAGES = 1000


@dataclass(frozen=True)
class Params:
    """Thresholds of matching; widths are in line pitches. Defaults are fixed values of the method."""

    max_width: float = 4.0
    min_width: float = 0.6
    min_match: float = 1.2
    edge: float = 1.0
    split_gap: float = 0.06
    size: float = 0.80
    z: float = 3.25
    margin: float = 0.75
    k: int = 3
    k_within: int = 5
    floor: float = 1.5
    hog_weight: float = 0.5
    dtw_weight: float = 0.5
    hog_dtw_weight: float = 0.0
    hog_steps: int = 32
    context_weight: float = 0.35
    context_cap: float = 3.0
    context_reach: int = 2

    @classmethod
    def of(cls, options: dict) -> Params:
        """From a dictionary; unknown names are refused."""
        unknown = set(options) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown parameters: {', '.join(sorted(unknown))}")
        return cls(**options)


def in_width(candidates: DataFrame, p: Params = Params()) -> DataFrame:  # noqa: B008
    """Candidates whose width is within the band."""
    return candidates.where((F.col("w") / F.col("unit")).between(p.min_width, p.max_width))


def blocks(candidates: DataFrame) -> DataFrame:
    """candidates(page, tok, cand, w, h, unit, feat, seq, hseq) as one row for each block of a page's candidates.

    Rows are numbered within a page by token, and a token's candidates share the
    block of the first, so a pair of tokens meets in one pair of blocks only. feat must have length 1; seq and hseq are flat with `steps` and
    `hog_steps` rows, or null; hseq may be missing.
    """
    if "hseq" not in candidates.columns:
        candidates = candidates.withColumn("hseq", F.lit(None).cast("array<double>"))
    n = F.rank().over(Window.partitionBy("page").orderBy("tok")) - 1
    rows = candidates.withColumn("block", F.floor(n / BLOCK).cast("int"))
    row = F.struct("tok", "cand", (F.col("w") / F.col("unit")).alias("w"), (F.col("h") / F.col("unit")).alias("h"), "feat", "seq", "hseq")
    return rows.groupBy("page", "block").agg(F.sort_array(F.collect_list(row)).alias("rows"))


#: Numbers of a block's candidates that are written as bytes, and their types; a row each, but for sizes, vectors and sequences.
_NUMBERS = {"tok": np.int64, "cand": np.int64, "k": np.int64, "size": np.float64, "feat": np.float64, "seq": np.float64, "hseq": np.float64}


def flat(b: DataFrame) -> DataFrame:
    """Blocks with each number of their rows as bytes: page, block, toks (the tokens, each once), n, tok, cand, size (width and
    height in pitches), feat, seq and hseq, null where a row has none. Rows may lack some of these, and have a number k."""
    fields = [f for f in b.schema["rows"].dataType.elementType.names if f not in ("w", "h")]
    sized = ["size"] if "w" in b.schema["rows"].dataType.elementType.names else []
    kinds = "page string, block int, toks array<long>, n long, " + ", ".join(f"{c} binary" for c in [*fields, *sized])
    schema = pa.schema([("page", pa.string()), ("block", pa.int32()), ("toks", pa.list_(pa.int64())), ("n", pa.int64()), *[(c, pa.binary()) for c in [*fields, *sized]]])

    def numbers(rows: pa.StructScalar, c: str) -> bytes | None:
        v = rows.field(c)
        if v.null_count:
            return None
        return np.ascontiguousarray((v.flatten() if pa.types.is_list(v.type) else v).to_numpy(zero_copy_only=False), dtype=_NUMBERS[c]).tobytes()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for page, block, rows in zip(*[batch.column(c) for c in ("page", "block", "rows")], strict=True):
                rows = rows.values
                row = {"page": page.as_py(), "block": block.as_py(), "n": len(rows), **{c: numbers(rows, c) for c in fields}}
                row["toks"] = np.unique(np.frombuffer(row["tok"], dtype=np.int64)).tolist() if "tok" in fields else []
                if sized:
                    row["size"] = np.stack([rows.field(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in ("w", "h")], axis=1).tobytes()
                yield pa.RecordBatch.from_pylist([row], schema)

    return b.select("page", "block", "rows").mapInArrow(pack, kinds)


@dataclass(frozen=True)
class Cells:
    """Pairs of flat blocks that are compared: of a page with itself (all orientations), of every two pages (the lower first), or both.

    left and right are the blocks with what each side knows besides: maps by the
    other page.
    """

    left: DataFrame
    right: DataFrame
    parts: int
    within: bool
    cross: bool
    dealt: bool = False

    def near(self) -> Column:
        """Whether blocks of page and r_page are compared."""
        kinds = [c for c, wanted in ((F.col("page") == F.col("r_page"), self.within), (F.col("page") < F.col("r_page"), self.cross)) if wanted]
        return reduce(Column.__or__, kinds, F.lit(False))

    def compared(self, each: Callable[[dict, dict], pd.DataFrame | None], schema: str, columns: list[str], known: tuple[str, ...] = (), asked: str | None = None) -> DataFrame:
        """each(block a, block b) for every pair, one row set after another; blocks have columns, and what left and right know of the other's page.

        Blocks are dealt to partitions of CELL_BLOCKS, once for each side, and
        partitions meet where they are read: a block is written twice, however
        many it meets. Sides that are dealt already stay as they are. If asked is
        named, only pairs whose left block knows it meet.
        """
        names, columns = [c.split()[0] for c in schema.split(", ")], ["page", "block", *columns]
        left, right = [df.select(*columns, *[c for c in known if c in df.columns]) for df in (self.left, self.right)]
        if not self.dealt:
            left, right = left.repartition(self.parts), right.repartition(self.parts)
        right = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns])
        pairs = left.hint("shuffle_replicate_nl").join(right, self.near())
        mine = [F.col(c)[F.col("r_page")].alias(c) for c in known if c in left.columns]
        theirs = [F.col(f"r_{c}")[F.col("page")].alias(f"r_{c}") for c in known if f"r_{c}" in right.columns]
        pairs = pairs.select(*columns, *mine, *[f"r_{c}" for c in columns], *theirs)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for row in batch.to_dict("records"):
                    x, y = {c: v for c, v in row.items() if c[:2] != "r_"}, {c[2:]: v for c, v in row.items() if c[:2] == "r_"}
                    found = each(x, y)
                    if found is not None and len(found):
                        yield found[names]

        return (pairs if asked is None else pairs.where(F.col(asked).isNotNull())).mapInPandas(run, schema)


def block_pairs(b: DataFrame, within: bool = True, cross: bool = True) -> Cells:
    """Pairs of blocks, flat ones or as blocks gives them, of every page with itself (all orientations) and of every two pages, the lower first.

    b is written already: its blocks are counted here.
    """
    if "rows" in b.columns:
        b = stored(flat(b), "flat-blocks")
    n, cores = b.count(), b.sparkSession.sparkContext.defaultParallelism
    parts = max(1, -(-n // CELL_BLOCKS), min(n, math.ceil(math.sqrt(8 * cores))))  # by number: a task's work is the product of its sides
    return Cells(b, b, parts, within, cross)


def _columns(names: list[str], *more: str) -> list[str]:
    """The columns of flat blocks that components need, and more."""
    return [*more, *[key for key, name in (("feat", "cos"), ("seq", "dtw"), ("hseq", "hog_dtw")) if name in names]]


def _arrays(block: dict) -> dict[str, np.ndarray]:
    """A flat block's numbers as arrays: size holds logarithms."""
    out = {c: np.frombuffer(v, dtype=_NUMBERS[c]) for c, v in block.items() if c in _NUMBERS}
    rows = len(next(out[c] for c in ("tok", "cand", "k") if c in out))
    for c in {"size", "feat", "seq", "hseq"} & out.keys():
        out[c] = out[c].reshape(rows, -1)
    if "size" in out:
        out["width"], out["size"] = out["size"][:, 0], np.log(out["size"])
    return out


def _components(a: dict, b: dict, p: Params, steps: int, names: list[str]) -> dict[str, np.ndarray]:
    """Component matrices of a pair of blocks, by name. Distances are negated."""
    out = {}
    if "cos" in names:
        out["cos"] = K.cosines(a["feat"], b["feat"])
    for name, key, length in (("dtw", "seq", steps), ("hog_dtw", "hseq", p.hog_steps)):
        if name in names:
            out[name] = -K.dtw(a[key].reshape(len(a[key]), length, -1), b[key].reshape(len(b[key]), length, -1))
    return out


def _weights(p: Params) -> dict[str, float]:
    """Components with a weight, by name."""
    return {n: w for n, w in (("cos", p.hog_weight), ("dtw", p.dtw_weight), ("hog_dtw", p.hog_dtw_weight)) if w > 0}


def moments(pairs: Cells, p: Params, steps: int = 40) -> DataFrame:
    """For each comparison, the number of entries and each component's mean and population deviation.

    The cosines of two blocks of unit vectors sum to the product of the vectors'
    sums, and their squares to the product of the two Gram matrices, so they are
    never formed here, and sums of each page are enough; distances are.
    """
    names, by = list(_weights(p)), ["page_a", "page_b"]
    formed = [n for n in names if n != "cos"]
    found = []
    if "cos" in names:
        sums = stored(_page_sums(packed(pairs.left)), "page-sums")
        found.append(_page_moments(sums, pairs.near()).select(F.col("page").alias("page_a"), F.col("r_page").alias("page_b"), F.col("m").alias("m_cos"), F.col("d").alias("d_cos")))
    if formed:

        def each(x: dict, y: dict) -> pd.DataFrame:
            a, b = _arrays(x), _arrays(y)
            row = {"page_a": x["page"], "page_b": y["page"], "n": len(a["tok"]) * len(b["tok"])}
            for k, v in _components(a, b, p, steps, formed).items():
                row |= {f"s_{k}": v.sum(), f"q_{k}": (v * v).sum()}
            return pd.DataFrame([row])

        kinds = "page_a string, page_b string, n long, " + ", ".join(f"s_{k} double, q_{k} double" for k in formed)
        sums = pairs.compared(each, kinds, _columns(formed, "tok")).groupBy(*by).agg(*[F.sum(c).alias(c) for c in ["n", *[x + k for k in formed for x in ("s_", "q_")]]])
        mean = {k: F.col(f"s_{k}") / F.col("n") for k in formed}
        spread = {k: F.sqrt(F.greatest(F.lit(0.0), F.col(f"q_{k}") / F.col("n") - mean[k] * mean[k])) for k in formed}
        found.append(sums.select(*by, *[mean[k].alias(f"m_{k}") for k in formed], *[spread[k].alias(f"d_{k}") for k in formed]))
    return reduce(lambda x, y: x.join(y, by), found).select(*by, *[f"m_{k}" for k in names], *[f"d_{k}" for k in names])


def candidate_scores(pairs: Cells) -> DataFrame:
    """The score matrices as rows: the cosine of every pair of candidates of every comparison, with their tokens and sizes in pitches."""
    kinds = "page_a string, page_b string, tok_a long, tok_b long, i long, j long, score double, w_a double, w_b double"

    def each(x: dict, y: dict) -> pd.DataFrame:
        a, b = _arrays(x), _arrays(y)
        i, j = np.repeat(np.arange(len(a["tok"])), len(b["tok"])), np.tile(np.arange(len(b["tok"])), len(a["tok"]))
        return pd.DataFrame({
            "page_a": x["page"], "page_b": y["page"], "tok_a": a["tok"][i], "tok_b": b["tok"][j], "i": a["cand"][i], "j": b["cand"][j],
            "score": K.cosines(a["feat"], b["feat"]).ravel(), "w_a": np.exp(a["size"][i, 0]), "w_b": np.exp(b["size"][j, 0]),
        })

    return pairs.compared(each, kinds, ["tok", "cand", "size", "feat"])


def _known(c: str) -> Column:
    """A column of a comparison's results, null where tokens have no allowed pair."""
    none = F.col("i") < 0
    return F.when(~none if c in ("i", "j") else ~none & ~F.isnan(c), F.col(c)).alias(c)


def token_best(pairs: Cells, least_width: float = 0.0) -> DataFrame:
    """For each pair of tokens of a comparison: u, the best cosine; t, the best of candidates of least_width pitches or more; and the (i, j) that reach t, the first in row order."""
    kinds = "page_a string, page_b string, tok_a long, tok_b long, u double, t double, i long, j long"

    def each(x: dict, y: dict) -> pd.DataFrame:
        a, b = _arrays(x), _arrays(y)
        fine = (a["width"] >= least_width)[:, None] & (b["width"] >= least_width)[None]
        ta, tb, u, t, i, j = K.best_by_token(K.cosines(a["feat"], b["feat"]), fine, a["tok"], b["tok"])
        i, j = i.ravel(), j.ravel()
        return pd.DataFrame({
            "page_a": x["page"], "page_b": y["page"], "tok_a": np.repeat(ta, len(tb)), "tok_b": np.tile(tb, len(ta)), "u": u.ravel(),
            "t": np.where(i >= 0, t.ravel(), np.nan), "i": np.where(i >= 0, a["cand"][i], -1), "j": np.where(i >= 0, b["cand"][j], -1),
        })

    rows = pairs.compared(each, kinds, ["tok", "cand", "size", "feat"])
    return rows.select("page_a", "page_b", "tok_a", "tok_b", "u", *[_known(c) for c in ("t", "i", "j")])


def standard_scores(pairs: Cells) -> DataFrame:
    """The cosine of every pair of candidates as a standard score of its comparison, z; moments go to the blocks, so no pair is shuffled."""
    left = _with_moments(pairs, moments(pairs, Params(dtw_weight=0.0)), ["m_cos", "d_cos"])
    kinds = "page_a string, page_b string, i long, j long, z double"

    def each(x: dict, y: dict) -> pd.DataFrame:
        a, b = _arrays(x), _arrays(y)
        mean, deviation = x["moments"]
        i, j = np.repeat(a["cand"], len(b["cand"])), np.tile(b["cand"], len(a["cand"]))
        return pd.DataFrame({"page_a": x["page"], "page_b": y["page"], "i": i, "j": j, "z": ((K.cosines(a["feat"], b["feat"]) - mean) / (deviation + 1e-8)).ravel()})

    return replace(pairs, left=left).compared(each, kinds, ["cand", "feat"], ("moments",))


def top_pairs(pairs: Cells, k: int) -> DataFrame:
    """The k pairs of candidates with the greatest cosine of all comparisons, equals by i and j, in this order: page_a, page_b, i, j, score.

    feat may have any length. Each pair of blocks gives its own k: a product of
    matrices tells which pairs may be among them, and only these are summed
    again, number by number, so copies of a vector tie wherever they stand. A
    vector of length 0 has a score of NaN, which comes first.
    """
    kinds = "page_a string, page_b string, i long, j long, score double"

    def each(x: dict, y: dict) -> pd.DataFrame:
        a, b = _arrays(x), _arrays(y)
        f, g = a["feat"], b["feat"]
        with np.errstate(invalid="ignore"):
            rough = K.cosines(f, g) / np.sqrt((f * f).sum(axis=1)[:, None] * (g * g).sum(axis=1)[None])
        rough = np.where(np.isnan(rough), np.inf, rough)
        least = np.partition(rough, max(0, rough.size - k), axis=None)[max(0, rough.size - k)]
        i, j = np.nonzero(rough >= least - 1e-9)
        score, i_of, j_of = K.cosine_rows(f, g, i, j), a["cand"][i], b["cand"][j]
        score = np.where(np.isnan(score), np.inf, score)  # NaN would leave pandas as null
        first = np.lexsort((j_of, i_of, -score))[:k]
        return pd.DataFrame({"page_a": x["page"], "page_b": y["page"], "i": i_of[first], "j": j_of[first], "score": score[first]})

    rows = pairs.compared(each, kinds, ["cand", "feat"]).orderBy(F.desc("score"), "i", "j").limit(k)
    return rows.withColumn("score", F.when(F.col("score") > 1, F.lit(float("nan"))).otherwise(F.col("score")))


def token_background(b: DataFrame, within: bool = True, cross: bool = True) -> DataFrame:
    """For each flat block and each page that it is compared with (other): mean and population deviation of the best cosine of
    each of its tokens with all tokens of that page, as bytes (spread): all means, then all deviations, in the order of toks.

    A block meets all blocks of a page in one task, one after another, each with
    a token's count, mean and sum of squares about that mean, which are put
    together about the mean of all, so near-constant values keep their digits.
    One row comes out for a block and a page. Every two blocks meet twice, once
    for the tokens of either. A page compared with itself leaves out each token
    with itself; a token without others has NaN.
    """
    sizes = stored(b.groupBy("page").agg(F.count("*").alias("blocks")), "page-blocks")
    pages, n, cores = sizes.count(), b.count(), b.sparkSession.sparkContext.defaultParallelism
    few = F.broadcast if pages <= BROADCAST_PAGES else lambda df: df
    taken, kept = max(1, min(n, 4 * cores), -(-n // TAKEN_BLOCKS)), max(1, min(pages, -(-n // KEPT_BLOCKS)))
    left = b.select("page", "block", "tok", "feat").repartition(taken)
    right = b.select("page", "block", "tok", "feat").join(few(sizes), "page").repartition(kept, "page").coalesce(kept)
    right = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns])
    kinds = [c for c, wanted in ((F.col("page") == F.col("r_page"), within), (F.col("page") != F.col("r_page"), cross)) if wanted]
    pairs = _product(left, right, reduce(Column.__or__, kinds, F.lit(False)))
    schema = "page string, block int, other string, spread binary"

    def part(tok: np.ndarray, f: np.ndarray, others: np.ndarray, g: np.ndarray, page: str, other: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ta, tb, u = K.best_of_tokens(K.cosines(f, g) if page <= other else K.cosines(g, f).T, tok, others)
        counted = ta[:, None] != tb[None] if page == other else np.ones((1, 1), dtype=bool)
        c = np.broadcast_to(counted, u.shape).sum(axis=1)
        m = np.where(counted, u, 0.0).sum(axis=1) / np.maximum(c, 1)
        q = np.where(counted, u - m[:, None], 0.0)
        return c, m, (q * q).sum(axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[tuple, dict] = {}
        for batch in batches:
            rows = []
            heads = batch.select(["page", "block", "r_page", "r_block", "r_blocks"]).to_pylist()
            blobs = [batch.column(c) for c in ("tok", "feat", "r_tok", "r_feat")]
            for k, h in enumerate(heads):
                tok, f, others, g = (np.frombuffer(c[k].as_buffer(), dtype=t) for c, t in zip(blobs, (np.int64, np.float64) * 2, strict=True))
                key = (h["page"], h["block"], h["r_page"])
                met.setdefault(key, {})[h["r_block"]] = part(tok, f.reshape(len(tok), -1), others, g.reshape(len(others), -1), h["page"], h["r_page"])
                if len(met[key]) == h["r_blocks"]:
                    c, m, q = (np.stack(v) for v in zip(*[v for _, v in sorted(met.pop(key).items())], strict=True))
                    total = c.sum(axis=0)
                    none = np.where(total > 0, 0.0, np.nan)
                    mean = (c * m).sum(axis=0) / np.maximum(total, 1)
                    spread = np.sqrt((q + c * (m - mean) ** 2).sum(axis=0) / np.maximum(total, 1))
                    rows.append({"page": key[0], "block": key[1], "other": key[2], "spread": np.concatenate([mean + none, spread + none]).tobytes()})
            yield pa.RecordBatch.from_pylist(rows, _arrow(schema))
        if met:
            raise RuntimeError(f"{len(met)} blocks did not meet all of a page in their task")

    return pairs.mapInArrow(run, schema)


def background_scores(b: DataFrame, within: bool = True, cross: bool = True) -> DataFrame:
    """z of each pair of tokens of a comparison: the lower standard score of its best cosine against its row's and its column's background.

    b is written already, flat or not. Blocks are compared twice more for the
    backgrounds, which go to the blocks, so pairs of tokens are neither stored
    nor shuffled. A block gets as many as its tokens times the pages that it
    meets, of two numbers.
    """
    pairs = block_pairs(b, within, cross)
    of, by = stored(token_background(pairs.left, within, cross), "backgrounds"), ["page", "block"]
    known = of.repartition(pairs.parts, *by).groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("other", "spread"))).alias("known"))
    side = pairs.left.select(*by, "tok", "feat").repartition(pairs.parts, *by).join(known, by, "left")  # dealt alike: no block is sent again
    kinds = "page_a string, page_b string, tok_a long, tok_b long, z double"

    def each(x: dict, y: dict) -> pd.DataFrame:
        a, c = _arrays(x), _arrays(y)
        ta, tb, u = K.best_of_tokens(K.cosines(a["feat"], c["feat"]), a["tok"], c["tok"])
        (ma, da), (mb, db) = (np.frombuffer(r["known"]).reshape(2, -1) for r in (x, y))
        z = np.minimum((u - ma[:, None]) / (da[:, None] + 1e-8), (u - mb) / (db + 1e-8))
        out = pd.DataFrame({"page_a": x["page"], "page_b": y["page"], "tok_a": np.repeat(ta, len(tb)), "tok_b": np.tile(tb, len(ta)), "z": z.ravel()})
        return out[out["tok_a"] != out["tok_b"]] if x["page"] == y["page"] else out

    return replace(pairs, left=side, right=side, dealt=True).compared(each, kinds, ["tok", "feat"], ("known",))


def _with_moments(pairs: Cells, of: DataFrame, names: list[str]) -> DataFrame:
    """Left blocks with the moments of their page's comparisons, by the other page: as many as pages it meets, of a few numbers."""
    return _knowing_moments(pairs, stored(of, "moments"), names)


def _knowing_moments(pairs: Cells, of: DataFrame, names: list[str]) -> DataFrame:
    known = of.groupBy("page_a").agg(F.map_from_entries(F.collect_list(F.struct("page_b", F.array(*names)))).alias("moments"))
    known = known if known.count() > BROADCAST_PAGES else F.broadcast(known)
    return pairs.left.join(known, F.col("page") == F.col("page_a")).drop("page_a")


def _scorer(p: Params, steps: int) -> Callable[[dict, dict[str, np.ndarray]], np.ndarray]:
    """The mixed standard score of components of entries of block x with entries of another; x knows their moments."""
    weights = _weights(p)
    total, names = sum(weights.values()), _moment_names(p)

    def score(x: dict, m: dict[str, np.ndarray]) -> np.ndarray:
        stat = dict(zip(names, x["moments"], strict=True))
        mixed = sum(w * (m[k] - stat[f"m_{k}"]) / (stat[f"d_{k}"] + 1e-8) for k, w in weights.items()) / total
        return np.round(mixed, 9)  # equal candidates tie, whatever the order of summation

    return score


def _moment_names(p: Params) -> list[str]:
    return [f"{x}_{k}" for k in _weights(p) for x in ("m", "d")]


def _fine(a: np.ndarray, b: np.ndarray, p: Params) -> np.ndarray:
    """Whether sizes (logarithms of width and height, last axis) are alike and both long enough."""
    wide, high = a[..., 0] - b[..., 0], a[..., 1] - b[..., 1]
    alike = wide * wide + high * high <= (-math.log(p.size) + 1e-9) ** 2
    return alike & (np.exp(a[..., 0]) >= p.min_match) & (np.exp(b[..., 0]) >= p.min_match)


def token_scores(pairs: Cells, p: Params, steps: int = 40) -> DataFrame:
    """For each pair of tokens of a comparison: u, the best mixed score of all candidate pairs; t, the best of those alike
    in size and long enough; and the candidates i, j that reach t, with their cosine and distance.

    A page compared with itself leaves out each token with itself, but its moments don't.
    """
    weights, score_of = _weights(p), _scorer(p, steps)
    left = _with_moments(pairs, moments(pairs, p, steps), _moment_names(p))

    def each(x: dict, y: dict) -> pd.DataFrame:
        a, b = _arrays(x), _arrays(y)
        m = _components(a, b, p, steps, list(weights))
        ta, tb, u, t, i, j = K.best_by_token(score_of(x, m), _fine(a["size"][:, None], b["size"][None], p), a["tok"], b["tok"])
        kept = ta[:, None] != tb[None] if x["page"] == y["page"] else np.ones(u.shape, dtype=bool)
        ga, gb = np.nonzero(kept)
        i, j, t = i[ga, gb], j[ga, gb], t[ga, gb]
        got = i >= 0
        none = np.where(got, 0.0, np.nan)
        at = lambda k: m[k][i, j] + none if k in m else np.full(len(i), np.nan)
        return pd.DataFrame({
            "page_a": x["page"], "page_b": y["page"], "tok_a": ta[ga], "tok_b": tb[gb], "u": u[ga, gb],
            "t": np.where(got, t, np.nan), "i": np.where(got, a["cand"][i], -1), "j": np.where(got, b["cand"][j], -1),
            "cos": at("cos"), "dtw": -at("dtw"), "hog_dtw": -at("hog_dtw"),
        })

    rows = replace(pairs, left=left).compared(each, _SCORES, _columns(list(weights), "tok", "cand", "size"), ("moments",))  # two tokens meet in one pair of blocks
    return rows.select("page_a", "page_b", "tok_a", "tok_b", "u", *[_known(c) for c in ("t", "i", "j", "cos", "dtw", "hog_dtw")])


def packed(b: DataFrame) -> DataFrame:
    """Flat blocks with sums: page, block, n, each row's token by its number within the block (tok), the vectors (feat), their sum (s)
    and their Gram matrix (q), or again the vectors if these take less."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for x in batch.to_dict("records"):
                a = _arrays(x)
                f, tok = a["feat"], np.cumsum(np.diff(a["tok"], prepend=a["tok"][0]) != 0, dtype=np.int32)
                yield pd.DataFrame([(x["page"], x["block"], len(f), tok.tobytes(), f.tobytes(), f.sum(axis=0).tobytes(), (f if len(f) < f.shape[1] else f.T @ f).tobytes())], columns=["page", "block", "n", "tok", "feat", "s", "q"])

    return b.select("page", "block", "tok", "feat").mapInPandas(pack, "page string, block int, n long, tok binary, feat binary, s binary, q binary")


def _gram(n: int, q: np.ndarray) -> np.ndarray:
    """The Gram matrix of n vectors from what packed has of it."""
    return q.T @ q if n < q.shape[1] else q


def _sums_read(x: dict, of: str = "") -> tuple[int, np.ndarray, np.ndarray]:
    s = np.frombuffer(x[of + "s"])
    return x[of + "n"], s, np.frombuffer(x[of + "q"]).reshape(-1, len(s))


def _page_sums(b: DataFrame) -> DataFrame:
    """Of each page of packed blocks: blocks, n, s and q over all. A task adds up one page after another, in the order of blocks."""
    kinds = "page string, blocks int, n long, s binary, q binary"

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, blocks, held = None, 0, None
        row = lambda: pa.RecordBatch.from_pylist([{"page": page, "blocks": blocks, "n": held[0], "s": held[1].tobytes(), "q": held[2].tobytes()}], _arrow(kinds))
        for batch in batches:
            for x in batch.to_pylist():
                n, s, q = _sums_read(x)
                if held is not None and x["page"] == page:
                    m, t, r = held
                    blocks, held = blocks + 1, (m + n, t + s, np.concatenate([r, q]) if m + n < len(s) else _gram(m, r) + _gram(n, q))
                    continue
                if held is not None:
                    yield row()
                page, blocks, held = x["page"], 1, (n, s, q)
        if held is not None:
            yield row()

    return b.select("page", "block", "n", "s", "q").repartition("page").sortWithinPartitions("page", "block").mapInArrow(add, kinds)


def _arrow(kinds: str) -> pa.Schema:
    types = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64()}
    return pa.schema([(c.split()[0], types[c.split()[1]]) for c in kinds.split(", ")])


def _product(left: DataFrame, right: DataFrame, near: Column | None = None) -> DataFrame:
    """Every row of left (page, l_...) with every row of right (r_page, r_...) of another page, or of those near. Partitions meet; neither side is shuffled, written or sent whole."""
    return left.hint("shuffle_replicate_nl").join(right, F.col("page") != F.col("r_page") if near is None else near)


def _page_moments(sums: DataFrame, near: Column | None = None) -> DataFrame:
    """Mean m and population deviation d of the cosines of every page with every other, or those near, from their sums: no pair of candidates is formed."""
    kinds = "page string, r_page string, m double, d double"

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x in batch.to_pylist():
                (n, s, q), (k, t, r) = _sums_read(x), _sums_read(x, "r_")
                m = float((s * t).sum()) / (n * k)
                v = float((_gram(n, q) * _gram(k, r)).sum()) / (n * k) - m * m
                rows.append({"page": x["page"], "r_page": x["r_page"], "m": m, "d": 0.0 if v < 0 else math.sqrt(v)})
            yield pa.RecordBatch.from_pylist(rows, _arrow(kinds))

    cols = ["page", "n", "s", "q"]
    return _product(sums.select(*cols), sums.select(*[F.col(c).alias(f"r_{c}") for c in cols]), near).mapInArrow(each, kinds)


def gold_ranks(candidates: DataFrame, p: Params, least: float) -> DataFrame:
    """Of every two pages, how often each rank occurs among the pairs of tokens whose u is least or more, in their rows and in
    their columns: page_a, page_b, rank, n.

    What scores higher than such a pair is one too, so a token's ranks follow
    from its own list of them. A block meets all blocks of another page in one
    task, one after another, where its tokens' lists are ranked; only counts come
    out. Every two blocks meet twice, once for the ranks from either end. Blocks
    are dealt once to partitions of whole pages and once to even ones, and
    partitions meet where they are read, so disk grows with the rows, not with
    their pairs. Only the cosine may have a weight.
    """
    if list(_weights(p)) != ["cos"]:
        raise ValueError("only the cosine may have a weight")
    score_of = _scorer(p, 0)
    b = stored(packed(flat(blocks(candidates))), "packed")
    sums = stored(_page_sums(b), "page-sums")
    pages, n, cores = sums.count(), b.count(), b.sparkSession.sparkContext.defaultParallelism
    few = F.broadcast if pages <= BROADCAST_PAGES else lambda df: df
    of = stored(_page_moments(sums), "moments").groupBy("page").agg(F.map_from_entries(F.collect_list(F.struct("r_page", F.array("m", "d")))).alias("moments"))
    taken, kept = max(1, min(n, 4 * cores), -(-n // TAKEN_BLOCKS)), max(1, min(pages, -(-n // KEPT_BLOCKS)))
    left = b.select("page", "block", "tok", "feat").join(few(of), "page").repartition(taken)
    right = b.select("page", "tok", "feat").join(few(sums.select("page", "blocks")), "page").repartition(kept, "page").coalesce(kept)
    pairs = _product(left, right.select(*[F.col(c).alias(f"r_{c}") for c in ("page", "tok", "feat", "blocks")]))
    pairs = pairs.select("page", "block", "r_page", "r_blocks", F.col("moments")[F.col("r_page")].alias("moments"), "tok", "feat", "r_tok", "r_feat")
    kinds = "page_a string, page_b string, rank long, n long"

    def found(x: tuple, y: tuple, page: str, other: str, moments: list[float]) -> tuple[np.ndarray, np.ndarray]:
        """Of a block's pairs of tokens with u of least or more: the row's token, and u."""
        (of_x, f), (of_y, g) = x, y
        cos = K.cosines(f, g) if page < other else K.cosines(g, f).T  # the same bits from either end
        i, j = np.nonzero(cos >= moments[0] + (least - 1e-6) * (moments[1] + 1e-8))
        u = score_of({"moments": moments}, {"cos": cos[i, j]})
        i, j, u = i[u >= least], j[u >= least], u[u >= least]
        row, col = of_x[i], of_y[j]
        order = np.lexsort((-u, col, row))
        row, col, u = row[order], col[order], u[order]
        first = np.ones(len(u), dtype=bool)
        first[1:] = (row[1:] != row[:-1]) | (col[1:] != col[:-1])
        return row[first], u[first]

    def ranks(row: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks within rows, equals sharing the first, and how often each occurs."""
        order = np.lexsort((-u, row))
        row, u = row[order], u[order]
        place, new = np.arange(len(u)), np.ones(len(u), dtype=bool)
        new[1:] = row[1:] != row[:-1]
        start = np.maximum.accumulate(np.where(new, place, 0))
        new[1:] |= u[1:] != u[:-1]
        return np.unique(np.maximum.accumulate(np.where(new, place, 0)) - start + 1, return_counts=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[tuple, list] = {}
        for batch in batches:
            out = {k: [] for k in ("page_a", "page_b", "rank", "n")}
            heads = batch.select(["page", "block", "r_page", "r_blocks", "moments"]).to_pylist()
            blobs = [batch.column(c) for c in ("tok", "feat", "r_tok", "r_feat")]
            for k, h in enumerate(heads):
                of_x, f, of_y, g = (np.frombuffer(c[k].as_buffer(), dtype=t) for c, t in zip(blobs, (np.int32, np.float64) * 2, strict=True))
                key = (h["page"], h["block"], h["r_page"])
                met.setdefault(key, []).append(found((of_x, f.reshape(len(of_x), -1)), (of_y, g.reshape(len(of_y), -1)), h["page"], h["r_page"], h["moments"]))
                if len(met[key]) == h["r_blocks"]:
                    rank, count = ranks(*[np.concatenate(v) for v in zip(*met.pop(key), strict=True)])
                    for c, v in zip(out, ([min(key[0], key[2])] * len(rank), [max(key[0], key[2])] * len(rank), rank.tolist(), count.tolist()), strict=True):
                        out[c] += v
            yield pa.RecordBatch.from_pydict(out, _arrow(kinds))
        if met:
            raise RuntimeError(f"{len(met)} blocks did not meet all of a page in their task")

    return pairs.mapInArrow(run, kinds).groupBy("page_a", "page_b", "rank").agg(F.sum("n").alias("n"))


_SCORES = "page_a string, page_b string, tok_a long, tok_b long, u double, t double, i long, j long, cos double, dtw double, hog_dtw double"


def leaders(pairs: Cells, p: Params, of: DataFrame, steps: int = 40) -> DataFrame:
    """Of each comparison, for each token of either side ("a" or "b"): mean and deviation of its u with all tokens of the other,
    and best, its k greatest t with the tokens that reach them, the first of equals first.

    Each pair of blocks gives two rows, with every token's count, mean, sum of
    squares about that mean and its k best, as arrays; those of a block and a
    page are put together in one task, so no pair of tokens leaves its blocks.
    of are moments.
    """
    weights, score_of = _weights(p), _scorer(p, steps)
    kinds = "page_a string, page_b string, side string, block int, other int, tok array<long>, n array<long>, m array<double>, q array<double>, t array<double>, at array<long>"
    out = "page_a string, page_b string, side string, tok long, mean double, deviation double, t array<double>, at array<long>"

    def each(x: dict, y: dict) -> pd.DataFrame:
        a, b = _arrays(x), _arrays(y)
        score = score_of(x, _components(a, b, p, steps, list(weights)))
        ta, tb, u, t = K.best_scores(score, _fine(a["size"][:, None], b["size"][None], p), a["tok"], b["tok"])
        within = x["page"] == y["page"]
        counted = ta[:, None] != tb[None] if within else np.ones(u.shape, dtype=bool)
        if within:
            t = np.where(counted, t, -np.inf)
        rows = []
        for side, block, other, tok, others, v, w, c in (("a", x, y, ta, tb, u, t, counted), ("b", y, x, tb, ta, u.T, t.T, counted.T)):
            n = c.sum(axis=1)
            m = (np.where(c, v, 0.0) if within else v).sum(axis=1) / np.maximum(n, 1)
            q = v - m[:, None]
            q = ((np.where(c, q, 0.0) if within else q) ** 2).sum(axis=1)
            best, places = K.greatest(np.ascontiguousarray(w), p.k_within if within else p.k)
            rows.append((x["page"], y["page"], side, block["block"], other["block"], tok, n, m, q, best.ravel(), others[places].ravel()))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in kinds.split(", ")])

    def together(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("other", kind="stable")
        n, m, q = (np.stack(rows[c].tolist()) for c in ("n", "m", "q"))
        tok, k = rows["tok"].iloc[0], p.k_within if key[0] == key[1] else p.k
        t, at = (np.concatenate([v.reshape(len(tok), -1) for v in rows[c]], axis=1) for c in ("t", "at"))
        order = np.lexsort((at, -t), axis=1)[:, :k]
        t, at = np.take_along_axis(t, order, axis=1), np.take_along_axis(at, order, axis=1)
        total = n.sum(axis=0)
        mean = (n * m).sum(axis=0) / np.maximum(total, 1)
        spread = np.sqrt((q + n * (m - mean) ** 2).sum(axis=0) / np.maximum(total, 1))
        real = [np.flatnonzero(v > -np.inf) for v in t]
        found = pd.DataFrame({
            "page_a": key[0], "page_b": key[1], "side": key[2], "tok": tok, "mean": mean, "deviation": spread,
            "t": [v[r] for v, r in zip(t, real, strict=True)], "at": [v[r] for v, r in zip(at, real, strict=True)],
        })
        return found[total > 0]

    left = _knowing_moments(pairs, of, _moment_names(p))
    parts = replace(pairs, left=left).compared(each, kinds, _columns(list(weights), "tok", "size"), ("moments",))
    return parts.groupBy("page_a", "page_b", "side", "block").applyInPandas(lambda key, rows: together(key, rows), out)


def asked_scores(pairs: Cells, p: Params, of: DataFrame, asked: DataFrame, steps: int = 40) -> DataFrame:
    """What token_scores gives, for the pairs of tokens in asked(page_a, page_b, tok_a, tok_b) alone, which are sent to the left blocks."""
    weights, score_of = _weights(p), _scorer(p, steps)
    places = pairs.left.select("page", "block", F.explode("toks").alias("tok"))
    placed = asked.join(places.select(F.col("page").alias("page_a"), "block", F.col("tok").alias("tok_a")), ["page_a", "tok_a"])
    sent = placed.groupBy("page_a", "block", "page_b").agg(F.sort_array(F.collect_list(F.struct("tok_b", "tok_a"))).alias("s"))
    sent = sent.groupBy(F.col("page_a").alias("page"), "block").agg(F.map_from_entries(F.collect_list(F.struct("page_b", F.array("s.tok_a", "s.tok_b")))).alias("asked"))
    left = _knowing_moments(pairs, of, _moment_names(p)).join(stored(sent, "asked"), ["page", "block"])

    def each(x: dict, y: dict) -> pd.DataFrame | None:
        tok_a, tok_b = (np.array(v, dtype=np.int64) for v in x["asked"])
        a, b = _arrays(x), _arrays(y)
        (ta, na), (tb, nb) = (np.unique(r["tok"], return_counts=True) for r in (a, b))
        low, high = np.searchsorted(tok_b, (tb[0], tb[-1] + 1))
        tok_a, tok_b = tok_a[low:high], tok_b[low:high]
        ia, ib = np.searchsorted(ta, tok_a), np.searchsorted(tb, tok_b)
        if not len(ia):
            return None
        heads, counts = [np.cumsum(n) - n for n in (na, nb)], na[ia] * nb[ib]
        starts = np.cumsum(counts) - counts
        place = np.arange(counts.sum()) - np.repeat(starts, counts)  # of candidate pairs within a pair of tokens, in row order
        i = np.repeat(heads[0][ia], counts) + place // np.repeat(nb[ib], counts)
        j = np.repeat(heads[1][ib], counts) + place % np.repeat(nb[ib], counts)
        m = {}
        for name in weights:
            if name == "cos":
                m[name] = np.einsum("ij,ij->i", a["feat"][i], b["feat"][j])
            else:
                key, length = ("seq", steps) if name == "dtw" else ("hseq", p.hog_steps)
                m[name] = -K.dtw_rows(a[key].reshape(len(a[key]), length, -1), b[key].reshape(len(b[key]), length, -1), i, j)
        score = score_of(x, m)
        gated = np.where(_fine(a["size"][i], b["size"][j], p), score, -np.inf)
        u, t = np.maximum.reduceat(score, starts), np.maximum.reduceat(gated, starts)
        hit = np.flatnonzero((gated == np.repeat(t, counts)) & (gated > -np.inf))
        of_hit = np.searchsorted(starts, hit, side="right") - 1
        first = np.full(len(starts), -1)
        first[of_hit[::-1]] = hit[::-1]
        got = first >= 0
        none = np.where(got, 0.0, np.nan)
        at = lambda k: m[k][first] + none if k in m else np.full(len(first), np.nan)
        return pd.DataFrame({
            "page_a": x["page"], "page_b": y["page"], "tok_a": tok_a, "tok_b": tok_b, "u": u, "t": np.where(got, t, np.nan),
            "i": np.where(got, a["cand"][i[first]], -1), "j": np.where(got, b["cand"][j[first]], -1), "cos": at("cos"), "dtw": -at("dtw"), "hog_dtw": -at("hog_dtw"),
        })

    rows = replace(pairs, left=left).compared(each, _SCORES, _columns(list(weights), "tok", "cand", "size"), ("moments", "asked"), "asked")
    return rows.select("page_a", "page_b", "tok_a", "tok_b", "u", *[_known(c) for c in ("t", "i", "j", "cos", "dtw", "hog_dtw")])


def accepted(known: DataFrame, p: Params) -> DataFrame:
    """Pairs that are among the k best both ways, within the margin of both bests, not below the floor, and whose z_base context
    could raise to z; pairs of a page with itself once. known are leaders, and a pair's rank is its place in both of its lists."""

    def side(s: str, own: str, other: str) -> DataFrame:
        rows = known.where(F.col("side") == s).select("page_a", "page_b", F.col("tok").alias(own), F.col("mean").alias(f"m_{s}"), F.col("deviation").alias(f"s_{s}"), F.get("t", F.lit(0)).alias(f"best_{s}"), F.explode(F.arrays_zip("t", "at")).alias("_l"))
        rows = rows.withColumns({other: F.col("_l.at"), f"t_{s}": F.col("_l.t")}).drop("_l")
        return rows.where((F.col(f"t_{s}") >= p.floor) & (F.col(f"t_{s}") >= F.col(f"best_{s}") - p.margin))

    both = side("a", "tok_a", "tok_b").join(side("b", "tok_b", "tok_a"), ["page_a", "page_b", "tok_a", "tok_b"])
    low = F.least(*[(F.col("t_a") - F.col(f"m_{s}")) / (F.col(f"s_{s}") + 1e-8) for s in "ab"])
    both = both.where((F.col("page_a") != F.col("page_b")) | (F.col("tok_a") < F.col("tok_b"))).select("page_a", "page_b", "tok_a", "tok_b", F.col("t_a").alias("score"), low.alias("z_base"))
    return both.where(F.col("z_base") >= p.z - max(0.0, p.context_weight * p.context_cap))


def matches(candidates: DataFrame, tokens: DataFrame, p: Params = Params(), within: bool = True, cross: bool = True, steps: int = 40) -> DataFrame:  # noqa: B008
    """All accepted matches: page_a, page_b, tok_a, tok_b, i, j, z, z_base, support, score, cos, dtw, hog_dtw.

    tokens(page, tok, col, line, pos) gives the reading order; a match is raised
    by the z of pairs next to it, across lines but not across columns.

    Every pair of tokens is scored in its blocks, where each token's background
    and best partners are found. What is among the best of both and may pass is
    few, and so are its neighbours in reading order: only these are scored again.
    """
    by = ["page_a", "page_b"]
    b = stored(flat(blocks(candidates)), "blocks")
    of = stored(moments(block_pairs(b, within, cross), p, steps), "moments")
    known = stored(leaders(block_pairs(b, within, cross), p, of, steps), "leaders")
    chosen = stored(accepted(known, p), "chosen")

    near = stored(J.reading_neighbours(tokens, p.context_reach, ["page", "col"], "tok", ["line", "pos", "tok"]).select("page", "tok", "side", "neighbour"), "neighbours")
    ra = near.select(F.col("page").alias("page_a"), F.col("tok").alias("tok_a"), "side", F.col("neighbour").alias("_na"))
    rb = near.select(F.col("page").alias("page_b"), F.col("tok").alias("tok_b"), "side", F.col("neighbour").alias("_nb"))
    beside = chosen.select(*by, "tok_a", "tok_b").join(ra, ["page_a", "tok_a"]).join(rb, ["page_b", "tok_b", "side"]).select(*by, "tok_a", "tok_b", "_na", "_nb")
    beside = stored(beside.where((F.col("page_a") != F.col("page_b")) | (F.col("_na") != F.col("_nb"))), "beside")
    asked = chosen.select(*by, "tok_a", "tok_b").unionByName(beside.select(*by, F.col("_na").alias("tok_a"), F.col("_nb").alias("tok_b"))).distinct()
    scores = stored(asked_scores(block_pairs(b, within, cross), p, of, asked, steps), "asked-scores")

    u = scores.select(*by, F.col("tok_a").alias("_na"), F.col("tok_b").alias("_nb"), "u")
    for s in "ab":
        u = u.join(known.where(F.col("side") == s).select(*by, F.col("tok").alias(f"_n{s}"), F.col("mean").alias(f"m_{s}"), F.col("deviation").alias(f"s_{s}")), [*by, f"_n{s}"])
    zu = F.least(*[(F.col("u") - F.col(f"m_{s}")) / (F.col(f"s_{s}") + 1e-8) for s in "ab"])
    support = beside.join(u.select(*by, "_na", "_nb", zu.alias("zu")), [*by, "_na", "_nb"]).groupBy(*by, "tok_a", "tok_b").agg(F.max("zu").alias("support"))
    rows = chosen.join(support, [*by, "tok_a", "tok_b"], "left").withColumn("support", F.greatest(F.coalesce("support", F.lit(0.0)), F.lit(0.0)))
    rows = rows.withColumn("z", F.col("z_base") + F.lit(p.context_weight) * F.least("support", F.lit(p.context_cap))).where(F.col("z") >= p.z)
    rows = rows.join(scores.select(*by, "tok_a", "tok_b", "i", "j", "cos", "dtw", "hog_dtw"), [*by, "tok_a", "tok_b"])
    return rows.select(*by, "tok_a", "tok_b", "i", "j", "z", "z_base", "support", "score", "cos", "dtw", "hog_dtw")


def similar(rows: DataFrame, key: str, vector: str, least: float) -> DataFrame:
    """Links (a, b) that connect rows whose vectors have a cosine of least or more: a join of all with all, in blocks.

    Of a pair of blocks only links to the least row of each set that is connected
    within it come out, as many as rows at most; components of these links are
    those of all pairs.
    """
    unit = rows.select(F.col(key).cast("long").alias("k"), V.scaled(F.col(vector)).alias("feat")).where("feat is not null")
    n = max(1, -(-unit.count() // BLOCK))
    b = unit.withColumn("block", F.pmod(F.xxhash64("k"), F.lit(n)).cast("int")).groupBy("block").agg(F.sort_array(F.collect_list(F.struct("k", "feat"))).alias("rows"))
    b = stored(flat(b.select(F.lit("").alias("page"), "block", "rows")), "vector-blocks")

    def each(x: dict, y: dict) -> pd.DataFrame | None:
        if x["block"] > y["block"]:
            return None
        both = [_arrays(r) for r in ((x,) if x["block"] == y["block"] else (x, y))]
        ids, f = (np.concatenate([r[c] for r in both]) for c in ("k", "feat"))
        order = np.argsort(ids, kind="stable")
        ids, f = ids[order], f[order]
        near = K.cosines(f, f) >= least
        label = np.arange(len(ids))
        while True:
            low = np.where(near, label[None], len(ids)).min(axis=1).clip(max=label)
            if np.array_equal(low, label):
                break
            label = low
        moved = np.flatnonzero(label != np.arange(len(ids)))
        return pd.DataFrame({"a": ids[moved], "b": ids[label[moved]]})

    return block_pairs(b, cross=False).compared(each, "a long, b long", ["k", "feat"]).distinct()


def summary(found: DataFrame, pages: DataFrame) -> DataFrame:
    """For each comparison: its type, how many matches, and how many only context carried; comparisons without a match count 0."""
    counts = found.groupBy("page_a", "page_b").agg(F.count("*").alias("n"), F.count_if((F.col("z_base") < F.col("z")) & (F.col("support") > 0)).alias("c"))
    every = J.page_pairs(pages)
    return every.join(counts, ["page_a", "page_b"], "left").select("page_a", "page_b", F.col("kind").alias("type"), F.coalesce("n", F.lit(0)).alias("n_matches"), F.coalesce("c", F.lit(0)).alias("n_context_only"))


def clusters(found: DataFrame, candidates: DataFrame, overlap: float = 0.5, numbered: bool = True) -> DataFrame:
    """Clusters of accepted matches. candidates(page, tok, cand, x0, ...) are named by cand alone if those are numbered
    through over all pages, else by page and number."""
    node = (lambda page, cand: cand) if numbered else (lambda page, cand: F.xxhash64(page, cand))
    edges = found.select(node(F.col("page_a"), F.col("i")).alias("a"), node(F.col("page_b"), F.col("j")).alias("b"), "z")
    members = candidates.select(node(F.col("page"), F.col("cand")).alias("node"), "page", F.col("tok").alias("token"), "cand", "x0", "y0", "x1", "y1")
    return A.cluster_summary(members, stored(edges, "edges"), overlap).drop("node")


def stages(found: DataFrame, candidates: DataFrame, only_groups: bool = False) -> dict[str, DataFrame]:
    """The folder run in three stages.

    groups: clusters of matches within each page, numbered page:gN by size and
    best z. elsewhere: for each group, the best occurrence for each token of
    other pages. clusters: over all matches, or over those of which an end is
    in a group.
    """
    inside = stored(found.where("page_a = page_b"), "within")
    between = stored(found.where("page_a <> page_b"), "between")
    rows = clusters(inside, candidates)
    order = Window.partitionBy("page").orderBy(F.desc("size"), F.desc("best_z"), "cluster")
    names = rows.select("page", "cluster", "size", "best_z").distinct().withColumn("group", F.concat("page", F.lit(":g"), F.row_number().over(order).cast("string")))
    groups = stored(rows.join(names.select("page", "cluster", "group"), ["page", "cluster"]).drop("n_pages"), "groups")
    both = between.select("page_a", "tok_a", "i", "page_b", "tok_b", "j", "z")
    turned = both.select(F.col("page_b").alias("page_a"), F.col("tok_b").alias("tok_a"), F.col("j").alias("i"), F.col("page_a").alias("page_b"), F.col("tok_a").alias("tok_b"), F.col("i").alias("j"), "z")
    ends = groups.select("group", F.col("page").alias("page_a"), F.col("token").alias("tok_a"))
    hits = both.unionByName(turned).join(ends, ["page_a", "tok_a"])
    elsewhere = hits.groupBy("group", F.col("page_b").alias("page"), F.col("tok_b").alias("token")).agg(F.max("z").alias("z"))
    elsewhere = groups.select("group").distinct().join(elsewhere, "group", "left").withColumn("found", F.when(F.col("page").isNull(), "no").otherwise("yes"))
    used = between
    if only_groups:
        used = J.touching(between, ends.select("page_a", "tok_a").distinct(), ["page_a", "tok_a"], ["page_b", "tok_b"], ["page_a", "tok_a"])
    return {"groups": groups, "elsewhere": elsewhere, "clusters": clusters(inside.unionByName(used), candidates)}


def cluster_pages(rows: DataFrame) -> DataFrame:
    """Each cluster's pages with their counts, its scope, and the pages on which it repeats."""
    counts = rows.groupBy("cluster", "page").agg(F.count("*").alias("n"))
    pages = F.sort_array(F.collect_list(F.struct("page", "n")))
    out = counts.groupBy("cluster").agg(pages.alias("p"), F.sum("n").alias("size"))
    text = F.array_join(F.transform("p", lambda x: F.concat(x["page"], F.lit(" x"), x["n"].cast("string"))), "; ")
    repeated = F.array_join(F.transform(F.filter("p", lambda x: x["n"] > 1), lambda x: x["page"]), "; ")
    scope = F.when(F.size("p") == 1, "within page").otherwise("across pages")
    return out.select("cluster", "size", F.size("p").alias("n_pages"), scope.alias("scope"), text.alias("pages"), repeated.alias("repeated_within"))


def page_summary(rows: DataFrame) -> DataFrame:
    """For each page: its clustered words, its clusters, and clusters with more than one word on it."""
    counts = rows.groupBy("page", "cluster").agg(F.count("*").alias("n"))
    return counts.groupBy("page").agg(F.sum("n").alias("words"), F.count("*").alias("clusters"), F.count_if(F.col("n") > 1).alias("repeated"))
