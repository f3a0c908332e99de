"""Operator 9: embedding near-dedup with a navigable small-world graph per shard.

Vectors of one label are dealt to shards of about SHARD vectors by the hash of their id. Every
shard gets a hierarchical navigable small-world graph: levels fall off geometrically, a new
vector is linked to the nearest that a beam search finds, links go both ways and are pruned with
a rule for diversity (a neighbour closer to another neighbour than to the vector itself comes
last), so a group of near copies keeps links to the rest. Insertion and search are done for
many vectors at a time, in numpy.

Every vector is a query in every shard of its label: each unordered pair of shards is one task,
in which one side's vectors search the other's graph; in their own shard they start from themselves.
Near copies share one wide beam: what any of them found, with its neighbours, until nothing new links. A sample of the queries is audited
against all vectors of the shard, more of them until enough links were seen; beams are widened until the
audit's recall is reached. The counts behind the audits are added up, and the recall comes with the
result. Links close to the limit are verified in double precision. A task returns counts and a
spanning forest of its links, so a large group of near copies sends one edge per vector; the
forests are united by connected components.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage
from .components import connected_components

SHARD = 8192
LINKS = 12
BEAM = 48
#: Queries audited at a time, links that an audit must have seen, the share of the queries that it asks at most for them, and the recall it demands.
AUDIT, EVIDENCE, RECALL = 64, 30, 0.99
LIMIT = 0.93
#: Queries that are searched together.
TOGETHER = 256


class Graph:
    """Layers of a small-world graph over unit vectors (float32); layer 0 holds all of them."""

    def __init__(self, vectors: np.ndarray, seed: int = 9):
        self.v = vectors
        n = len(vectors)
        u = np.random.default_rng(seed).random(n)
        self.level = np.minimum((-np.log(np.maximum(u, 1e-12)) / np.log(LINKS)).astype(np.int64), 8)
        self.layers = [np.full((n, LINKS * (2 if k == 0 else 1)), -1, np.int32) for k in range(int(self.level.max(initial=0)) + 1)]

    @property
    def entry(self) -> int:
        return int(np.argmax(self.level))

    def build(self) -> Graph:
        """Insert all vectors, the highest first, in batches that grow with the graph."""
        order = np.argsort(-self.level, kind="stable")
        for k in range(len(self.layers) - 1, -1, -1):
            members = order[self.level[order] >= k]
            done = min(len(members), 2 * TOGETHER)
            self._link(members[:done], members[:done], k)  # the first few, all against all
            while done < len(members):
                batch = members[done : done + TOGETHER]
                found = self.search(self.v[batch], BEAM, k)[0]
                self._link(batch, batch, k, found)
                done += len(batch)
        return self

    def _link(self, nodes: np.ndarray, own: np.ndarray, layer: int, found: np.ndarray | None = None) -> None:
        """Link nodes to their nearest in their own batch and among what a search found."""
        width = self.layers[layer].shape[1]
        sims = self.v[nodes] @ self.v[own].T
        sims[nodes[:, None] == own[None, :]] = -np.inf
        ids = np.broadcast_to(own, sims.shape)
        if found is not None:
            far = np.where(found >= 0, np.einsum("qd,qkd->qk", self.v[nodes], self.v[found]), -np.inf)
            sims, ids = np.concatenate([sims, far], axis=1), np.concatenate([ids, found], axis=1)
        k = min(LINKS, sims.shape[1])
        top = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        good = np.take_along_axis(sims, top, axis=1) > -np.inf
        a = np.repeat(nodes, k)[good.ravel()]
        b = np.take_along_axis(ids, top, axis=1).ravel()[good.ravel()]
        # both directions, with what is there already; the nearest stay, diverse ones first
        old = self.layers[layer]
        touched = np.unique(np.r_[a, b])
        have = old[touched]
        src = np.r_[a, b, np.repeat(touched, width)[have.ravel() >= 0]]
        dst = np.r_[b, a, have.ravel()[have.ravel() >= 0]]
        src, dst = np.divmod(np.unique(src.astype(np.int64) * len(self.v) + dst), len(self.v))
        near = np.einsum("kd,kd->k", self.v[src], self.v[dst])
        order = np.lexsort((-near, src))
        src, dst, near = src[order], dst[order], near[order]
        first = np.searchsorted(src, src)
        place = np.arange(len(src)) - first
        some = place < 2 * width
        src, dst, near, place = src[some], dst[some], near[some], place[some]
        own = np.searchsorted(touched, src)
        for at in range(0, len(touched), TOGETHER):
            of = touched[at : at + TOGETHER]
            mine = (own >= at) & (own < at + len(of))
            cand = np.full((len(of), 2 * width), -1, np.int64)
            sim = np.full(cand.shape, -np.inf, np.float32)
            cand[own[mine] - at, place[mine]], sim[own[mine] - at, place[mine]] = dst[mine], near[mine]
            old[of] = self._diverse(cand, sim, width)

    def _diverse(self, cand: np.ndarray, sim: np.ndarray, width: int) -> np.ndarray:
        """The ``width`` candidates of each row (nearest first) that stay: those nearer to the row's vector than to one chosen before, then the nearest others."""
        there = cand >= 0
        among = np.matmul(self.v[cand], self.v[cand].transpose(0, 2, 1))
        chosen = np.zeros(cand.shape, bool)
        for k in range(cand.shape[1]):
            crowd = np.where(chosen[:, :k], among[:, k, :k], -np.inf).max(axis=1, initial=-np.inf)
            chosen[:, k] = there[:, k] & (sim[:, k] > crowd)
        rank = np.where(chosen, 0, np.where(there, 1, 2)) * cand.shape[1] + np.arange(cand.shape[1])
        stay = np.argsort(rank, axis=1)[:, :width]
        return np.take_along_axis(cand, stay, axis=1)

    def search(self, queries: np.ndarray, beam: int, layer: int = 0, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, cosines) of the beam of each query on a layer, -1 where it is not full; descends from the top, or begins at ``start``."""
        q = len(queries)
        at = np.full(q, self.entry, np.int64) if start is None else start
        for k in range(len(self.layers) - 1, layer, -1) if start is None else ():
            at = self._greedy(queries, at, k)
        ids = np.full((q, beam), -1, np.int64)
        sims = np.full((q, beam), -np.inf, np.float32)
        open_ = np.zeros((q, beam), bool)
        ids[:, 0], sims[:, 0], open_[:, 0] = at, np.einsum("qd,qd->q", queries, self.v[at]), True
        seen = np.zeros((q, len(self.v)), bool)
        seen[np.arange(q), at] = True
        live = np.arange(q)
        step = max(4, beam // 32)
        while len(live):
            waiting = np.where(open_[live], sims[live], -np.inf)
            k = min(step, beam)
            best = np.argpartition(-waiting, k - 1, axis=1)[:, :k]
            is_open = np.take_along_axis(waiting, best, axis=1) > -np.inf
            some = is_open.any(axis=1)
            live, best, is_open = live[some], best[some], is_open[some]
            if not len(live):
                break
            open_[live[:, None], best] = False
            nodes = np.where(is_open, ids[live[:, None], best], -1)
            nxt = np.where(nodes[:, :, None] >= 0, self.layers[layer][nodes], -1).reshape(len(live), -1)
            fresh = (nxt >= 0) & ~seen[live[:, None], nxt]
            r, c = np.nonzero(fresh)
            seen[live[r], nxt[r, c]] = True
            new = np.full(nxt.shape, -np.inf, np.float32)
            new[r, c] = np.einsum("kd,kd->k", queries[live[r]], self.v[nxt[r, c]])
            # a node that two of the step's nodes share counts once
            order = np.argsort(nxt, axis=1, kind="stable")
            twice = np.zeros_like(fresh)
            ordered = np.take_along_axis(nxt, order, axis=1)
            np.put_along_axis(twice, order, np.concatenate([np.zeros((len(live), 1), bool), ordered[:, 1:] == ordered[:, :-1]], axis=1), axis=1)
            new[twice] = -np.inf
            all_s = np.concatenate([sims[live], new], axis=1)
            all_i = np.concatenate([ids[live], nxt], axis=1)
            all_o = np.concatenate([open_[live], new > -np.inf], axis=1)
            top = np.argpartition(-all_s, beam - 1, axis=1)[:, :beam]
            sims[live] = np.take_along_axis(all_s, top, axis=1)
            ids[live] = np.where(sims[live] > -np.inf, np.take_along_axis(all_i, top, axis=1), -1)
            open_[live] = np.take_along_axis(all_o, top, axis=1) & (sims[live] > -np.inf)
        return ids, sims

    def _greedy(self, queries: np.ndarray, at: np.ndarray, layer: int) -> np.ndarray:
        """The nearest node that steps to better neighbours reach on a layer."""
        at = at.copy()
        now = np.einsum("qd,qd->q", queries, self.v[at])
        live = np.arange(len(queries))
        while len(live):
            nxt = self.layers[layer][at[live]]
            sims = np.where(nxt >= 0, np.einsum("qd,qkd->qk", queries[live], self.v[nxt]), -np.inf)
            best = sims.argmax(axis=1)
            value = sims[np.arange(len(live)), best]
            better = value > now[live]
            live = live[better]
            at[live] = nxt[better, best[better]]
            now[live] = value[better]
        return at


def links_between(queries: np.ndarray, graph: Graph, limit: float, own: bool = False, near: float = 1e-4) -> tuple[np.ndarray, int, int]:
    """Which query (row) links to which vector of the graph, before the check in double precision; of the audited links, those found and all.

    ``own`` says that the queries are the graph's vectors, in order.
    """
    q, n = len(queries), len(graph.v)
    hit = np.zeros((q, n), bool)
    order = np.random.default_rng(1).permutation(q)
    truth: dict[int, np.ndarray] = {}
    links = 0
    while len(truth) < q and links < EVIDENCE:  # until there is evidence, or every query was asked
        some = order[len(truth) : len(truth) + AUDIT]
        real = queries[some] @ graph.v.T >= limit - near
        truth.update(zip(some.tolist(), real, strict=True))
        links += int(real.sum()) - own * len(some)
    sample = np.array(sorted(truth), np.int64)
    real = np.stack([truth[k] for k in sample.tolist()]) if len(sample) else np.zeros((0, n), bool)
    if own:
        real[np.arange(len(sample)), sample] = False
    beam = min(BEAM, n)
    while True:
        for k in range(0, q, TOGETHER):
            ids, sims = graph.search(queries[k : k + TOGETHER], beam, start=np.arange(k, min(k + TOGETHER, q)) if own else None)
            r, c = np.nonzero(sims >= limit - near)
            hit[k + r, ids[r, c]] = True
        if own:
            hit |= hit.T
            np.fill_diagonal(hit, False)
        _widen(hit, queries, graph, limit - near)
        if own:
            np.fill_diagonal(hit, False)
        found = int((hit[sample] & real).sum())
        if found >= RECALL * real.sum():
            break
        if beam >= n:  # parts of the graph that no search reaches: all vectors are seen
            for k in range(0, q, TOGETHER):
                hit[k : k + TOGETHER] = queries[k : k + TOGETHER] @ graph.v.T >= limit - near
            if own:
                np.fill_diagonal(hit, False)
            break
        beam = min(4 * beam, n)
    found = int((hit[sample] & real).sum())
    hit[sample] |= real  # what the audit saw is known anyhow
    return hit, found, int(real.sum()), len(truth)


def _widen(hit: np.ndarray, queries: np.ndarray, graph: Graph, limit: float) -> None:
    """Let the queries of each component of ``hit`` share one wide beam: all that any of them found, with its neighbours, until nothing new links.

    A beam holds the nearest only; in a large group of near copies there are more than it has room for.
    """
    rows, cols = _components(hit)
    by_row, by_col = np.argsort(rows, kind="stable"), np.argsort(cols, kind="stable")
    for k in np.unique(rows[rows >= 0]).tolist():
        own = by_row[slice(*np.searchsorted(rows[by_row], [k, k + 1]))]
        new = by_col[slice(*np.searchsorted(cols[by_col], [k, k + 1]))]
        known = np.zeros(len(graph.v), bool)
        while len(new):
            around = graph.layers[0][new]
            cand = np.union1d(new, around[around >= 0])
            cand = cand[~known[cand]]
            known[cand] = True
            linked = np.zeros(len(cand), bool)
            for m in range(0, len(own), TOGETHER):
                real = queries[own[m : m + TOGETHER]] @ graph.v[cand].T >= limit
                hit[np.ix_(own[m : m + TOGETHER], cand)] |= real
                linked |= real.any(axis=0)
            linked &= cols[cand] != k
            new = cand[linked]


def _components(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for the component of each row and column of a link matrix; -1 for those without a link. Every row and column is looked at once."""
    rows, cols = np.full(hit.shape[0], -1, np.int64), np.full(hit.shape[1], -1, np.int64)
    turned = np.ascontiguousarray(hit.T)
    for k, i in enumerate(np.flatnonzero(hit.any(axis=1)).tolist()):
        if rows[i] >= 0:
            continue
        rows[i], front = k, np.array([i])
        while len(front):
            side = np.flatnonzero(hit[front].any(axis=0) & (cols < 0))
            cols[side] = k
            front = np.flatnonzero(turned[side].any(axis=0) & (rows < 0)) if len(side) else side
            rows[front] = k
    return rows, cols


def _unit(rows: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in double and in single precision."""
    v = np.stack([np.asarray(x, np.float64) for x in rows])
    v = v / np.abs(v).max(axis=1, keepdims=True)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return v, v.astype(np.float32)


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("vec_id", ignore_index=True)
    graph = Graph(_unit(pdf["embedding"])[1]).build()
    pdf["level"] = graph.level.astype(np.int32)
    pdf["place"] = np.arange(len(pdf), dtype=np.int32)
    pdf["links"] = list(np.concatenate(graph.layers, axis=1))
    return pdf[["label", "dims", "shard", "shards", "vec_id", "embedding", "place", "level", "links"]]


_BUILT = "label string, dims int, shard int, shards int, vec_id long, embedding array<double>, place int, level int, links array<int>"
_FOUND = "label string, vec_id long, root long, n long, seen long, want long, asked long"


def _restored(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, Graph | None]:
    """Ids and vectors (double, single) of a shard, and its graph if the rows hold it."""
    pdf = pdf.sort_values("place", ignore_index=True)
    double, single = _unit(pdf["embedding"])
    graph = None
    if pdf["links"].notna().all():
        graph = Graph.__new__(Graph)
        graph.v, graph.level = single, pdf["level"].to_numpy(np.int64)
        links = np.stack(pdf["links"].to_numpy()).astype(np.int32)
        graph.layers = [links[:, : 2 * LINKS]] + [links[:, k : k + LINKS] for k in range(2 * LINKS, links.shape[1], LINKS)]
    return pdf["vec_id"].to_numpy(np.int64), double, single, graph


def _link_task(limit: float):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        label, _, a, b = key
        right = _restored(pdf[pdf["shard"] == b])
        left = right if a == b else _restored(pdf[pdf["shard"] == a])
        if not len(left[0]) or not len(right[0]):
            return pd.DataFrame({c.split()[0]: [] for c in _FOUND.split(", ")})
        hit, seen, want, asked = links_between(left[2], right[3], limit, own=a == b)
        if a == b:
            hit |= hit.T
        counts = [np.zeros(hit.shape[0], np.int64), np.zeros(hit.shape[1], np.int64)]
        for k in range(0, len(hit), TOGETHER):
            r, c = np.nonzero(hit[k : k + TOGETHER])
            for m in range(0, len(r), 1 << 18):
                rr, cc = r[m : m + (1 << 18)] + k, c[m : m + (1 << 18)]
                sure = np.einsum("kd,kd->k", left[1][rr], right[1][cc]) >= limit
                hit[rr[~sure], cc[~sure]] = False
                counts[0] += np.bincount(rr[sure], minlength=len(counts[0]))
                counts[1] += np.bincount(cc[sure], minlength=len(counts[1]))
        if a == b:
            np.fill_diagonal(hit, True)  # a vector is one node, as a query and as what is found
        rows, cols = _components(hit)
        both = [(left[0], rows, counts[0])] + ([(right[0], cols, counts[1])] if a != b else [])
        ids, of, n = (np.concatenate(x) for x in zip(*both, strict=True))
        some = n > 0
        ids, of, n = ids[some], of[some], n[some]
        least = np.full(int(of.max(initial=-1)) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, of, ids)
        out = pd.DataFrame({"vec_id": ids, "root": least[of], "n": n}).astype("Int64")
        audit = pd.DataFrame({"vec_id": [pd.NA], "root": [pd.NA], "n": [0], "seen": [seen], "want": [want], "asked": [asked]}).astype("Int64")
        return pd.concat([out, audit]).assign(label=label)[[c.split()[0] for c in _FOUND.split(", ")]]

    return run


def embedding_dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", limit: float = LIMIT, shard: int = SHARD) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept, recall, audited_links, audited_queries.

    Vectors are compared when their labels are equal and not null and they have equally many
    components; links join those found with a cosine of ``limit`` or more. A vector that is
    null, empty or zero or holds a null or non-finite component links with nothing, and so does
    a row with a null id (its component is null). Rows that repeat an id are one vector, the
    least of them. recall is the share of the audited links of the vector's label that the searches
    found (null where no audit saw a link), audited_links their number and audited_queries that of the searches that were
    held against all vectors of a shard: of each pair of shards as many as show EVIDENCE links, or all. Other columns are ignored; an empty table gives an empty result.
    """
    base = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = base.where("vec_id is not null and label is not null and size(embedding) > 0").where(finite & F.exists("embedding", lambda x: x != 0))
    usable = usable.groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("x")).select("vec_id", "x.label", "x.embedding", F.size("x.embedding").alias("dims"))
    usable = stage(usable, "vectors")
    sizes = usable.groupBy("label", "dims").agg(F.ceil(F.count("*") / shard).cast("int").alias("shards"))
    dealt = usable.join(sizes, ["label", "dims"]).withColumn("shard", F.expr("cast(pmod(xxhash64(vec_id), shards) as int)"))
    built = stage(dealt.groupBy("label", "dims", "shard").applyInPandas(_build, _BUILT), "graphs")
    pairs = built.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).withColumns({"a": F.least("shard", "other"), "b": F.greatest("shard", "other")})
    pairs = pairs.withColumn("links", F.when(F.col("shard") == F.col("b"), F.col("links")))  # only the searched side needs its graph
    found = stage(pairs.groupBy("label", "dims", "a", "b").applyInPandas(_link_task(limit), _FOUND), "links")
    counts = found.where("vec_id is not null").groupBy("vec_id").agg(F.sum("n").alias("n_links"))
    audits = stage(found.where("vec_id is null").groupBy("label").agg((F.sum("seen") / F.nullif(F.sum("want"), F.lit(0))).alias("recall"), F.sum("want").alias("audited_links"), F.sum("asked").alias("audited_queries")), "audits")
    roots = connected_components(found.select("vec_id", "root")).select(F.col("node").alias("vec_id"), "root")
    out = base.select("vec_id", "label").join(counts, "vec_id", "left").join(roots, "vec_id", "left").join(audits, "label", "left")
    component = F.coalesce("root", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"), "recall", F.coalesce("audited_links", F.lit(0)).alias("audited_links"), F.coalesce("audited_queries", F.lit(0)).alias("audited_queries"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector, labels apart, cosine 0.93 and more."""
    return embedding_dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: A graph search has no SQL; tests hold the query against all pairs.
SQL: dict[str, str] = {}
QUERIES = {"op9_embedding_dedup": op9_embedding_dedup}
