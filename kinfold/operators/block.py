"""Candidate pairs: cosine similarity and a two-sided gate of evidence."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import Blocking
from ..functions import domain, taxonomy, text
from ..schemas import conform, empty
from ..storage import written


def evidence(entities: DataFrame, channels: tuple[str, ...]) -> DataFrame:
    """entity_id, entity_type, kind, value: what pairs can share in each channel; taxonomy has codes and parents."""
    parts = []
    plain = {"email": F.col("emails"), "phone": F.col("phones"), "website": domain.contact_domains(F.array().cast("array<string>"), F.col("websites")), "location": text.location_keys(F.col("locations"))}
    for channel in channels:
        if channel != "taxonomy":
            parts.append(entities.select("entity_id", "entity_type", F.lit(channel).alias("kind"), F.explode(F.array_distinct(plain[channel])).alias("value")))
    out = parts[0] if parts else None
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def with_parents(codes: DataFrame) -> DataFrame:
    """codes with up, the parent of each code, worked out once for each distinct code."""
    ups = codes.select("code").distinct().withColumn("up", taxonomy.parent(F.col("code")))
    return codes.join(ups, "code")


#: Whether two entities, as :func:`comparable` has them, share evidence in a channel; more channels can be added.
EVALUATORS: dict[str, Callable[[Column, Column], Column]] = {
    "taxonomy": lambda a, b: F.arrays_overlap(a["codes"], b["codes"]) | F.arrays_overlap(a["codes"], b["ups"]) | F.arrays_overlap(a["ups"], b["codes"]),
    **{c: (lambda c: lambda a, b: F.arrays_overlap(a[c], b[c]))(c) for c in ("email", "phone", "website", "location")},
}


def comparable(entities: DataFrame) -> DataFrame:
    """entity_id, entity_type and own: codes, their parents and the values of each channel."""
    codes = entities.select("entity_id", "entity_type", F.explode(taxonomy.code_set(F.col("taxonomies"), F.col("services_rollup"))).alias("code"))
    lists = with_parents(codes).groupBy("entity_id", "entity_type").agg(F.collect_set("code").alias("codes"), F.collect_set("up").alias("ups"))
    none = F.array().cast("array<string>")
    plain = {"email": F.col("emails"), "phone": F.col("phones"), "website": domain.contact_domains(none, F.col("websites")), "location": text.location_keys(F.col("locations"))}
    own = F.struct(F.coalesce("codes", none).alias("codes"), F.coalesce("ups", none).alias("ups"), *[F.coalesce(c, none).alias(n) for n, c in plain.items()])
    return entities.join(lists, ["entity_id", "entity_type"], "left").select("entity_id", "entity_type", own.alias("own"))


def judged(near: DataFrame, entities: DataFrame, channels: tuple[str, ...]) -> DataFrame:
    """near with by_taxonomy and by_other: whether the evaluators of the channels find evidence on either side of the gate."""
    own = comparable(entities)
    out = near
    for side in ("anchor", "other"):
        out = out.join(own.select(F.col("entity_id").alias(side), "entity_type", F.col("own").alias(f"__{side}")), [side, "entity_type"])
    said = {c: F.coalesce(EVALUATORS[c](F.col("__anchor"), F.col("__other")), F.lit(False)) for c in channels}
    any_of = lambda names: reduce(or_, [said[c] for c in names], F.lit(False))
    return out.select(*near.columns, any_of([c for c in channels if c == "taxonomy"]).alias("by_taxonomy"), any_of([c for c in channels if c != "taxonomy"]).alias("by_other"))


#: Entities of a group that meet in one task, and rows of groups in one partition, about.
_BLOCK, _ROWS = 1 << 14, 50_000
#: Entities of a block of all at most, numbers of a product at a time, and how much less similar than the best of an anchor a pair may be that counts as equal.
_WIDE, _CHUNK, _SLACK = 1 << 16, 1 << 21, 1e-5
#: By so much may a product of normalised vectors of 32 bits differ from the cosine.
_MARGIN = 2e-5


def gate_first(entities: DataFrame, anchors: DataFrame, settings: Blocking) -> DataFrame:
    """Pairs of an anchor and another entity of its type with taxonomy and other evidence and a cosine from the threshold on: anchor, other, entity_type, similarity and the reasons.

    Entities meet in groups by value and code, so that a value which many entities share, such as a large city, only brings those together
    that are also related by taxonomy. Each goes to its groups with its vector, and pairs below the threshold are never written: what is sent
    grows with the entities and the similar pairs. Of these a group sends what is among the ``max_candidates`` best of one of both ends.
    """
    session = entities.sparkSession
    if "taxonomy" not in settings.channels or len(settings.channels) < 2:
        return session.createDataFrame([], "anchor string, other string, entity_type string, similarity double, reasons array<string>")
    codes = with_parents(entities.select("entity_id", "entity_type", F.explode(taxonomy.code_set(F.col("taxonomies"), F.col("services_rollup"))).alias("code")))
    # a code and its parent are keys, and in each pair of a group one entity at least has the key as its own code
    keys = F.explode(F.filter(F.array(F.struct(F.col("code").alias("c"), F.lit(True).alias("own")), F.struct(F.col("up").alias("c"), F.lit(False).alias("own"))), lambda x: x["c"].isNotNull()))
    keyed = codes.select("entity_id", "entity_type", keys.alias("key")).groupBy("entity_id", "entity_type", "key.c").agg(F.max("key.own").alias("own"))
    keyed = evidence(entities, settings.channels).join(keyed, ["entity_id", "entity_type"])
    group = [F.xxhash64(F.lit(seed), "entity_type", "kind", "value", "c").alias(name) for seed, name in ((1, "g"), (2, "h"))]
    is_anchor = anchors.select("entity_id", "entity_type").distinct().withColumn("anchor", F.lit(True))
    keyed = keyed.select("entity_id", "entity_type", "kind", "own", *group).join(is_anchor, ["entity_id", "entity_type"], "left").withColumn("anchor", F.coalesce("anchor", F.lit(False)))
    keyed = written(keyed, "keyed")
    sizes = keyed.groupBy("g", "h").agg(F.count("*").alias("n"), F.max("own").alias("any_own"), F.max("anchor").alias("any_anchor")).where("n > 1 and any_own and any_anchor")
    # of a group too large for one task, blocks meet two by two
    blocks = F.ceil(F.col("n") / _BLOCK)
    met = keyed.join(sizes.select("g", "h", blocks.alias("blocks")), ["g", "h"]).withColumn("b", F.pmod(F.xxhash64("entity_id"), F.col("blocks"))).withColumn("to", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    met = written(met.select("entity_id", "entity_type", "kind", "own", "anchor", "g", "h", F.least("b", "to").alias("x"), F.greatest("b", "to").alias("y"), (F.col("b") <= F.col("to")).alias("first")), "met")
    parts = max(int(session.conf.get("spark.sql.shuffle.partitions")), -(-met.count() // _ROWS))
    work = met.join(entities.select("entity_id", "entity_type", "embedding_vector"), ["entity_id", "entity_type"]).repartition(parts, "g", "h", "x", "y")
    hits = work.mapInArrow(_near(settings.similarity_threshold, settings.max_candidates), "a string, b string, entity_type string, kind string, similarity double, a_anchor boolean, b_anchor boolean")
    reasons = F.array_sort(F.array_union(F.collect_set(F.concat(F.lit("shared_"), "kind")), F.array(F.lit("embedding_threshold"), F.lit("shared_taxonomy"))))
    pairs = hits.groupBy("a", "b", "entity_type").agg(F.max("similarity").alias("similarity"), reasons.alias("reasons"), F.max("a_anchor").alias("a_anchor"), F.max("b_anchor").alias("b_anchor"))
    return _directed(pairs)


def _cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of the rows; zero vectors are similar to none."""
    size = np.maximum(np.linalg.norm(a, axis=1), 1e-8) * np.maximum(np.linalg.norm(b, axis=1), 1e-8)
    return np.einsum("ij,ij->i", a, b) / size


def _cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b = (np.array(batch.column(c).flatten(), float).reshape(batch.num_rows, -1) for c in ("va", "vb"))
        kept = [c for c in batch.schema.names if c not in ("va", "vb")]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(_cosine(a, b))], [*kept, "similarity"])


def _vectors(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of rows, all of one length, and the same normalised in 32 bits."""
    v = np.concatenate([x.flatten().to_numpy(zero_copy_only=False) for x in column.chunks]).astype(float).reshape(len(column), -1)
    return v, (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-8)).astype(np.float32)


def _best(i: np.ndarray, j: np.ndarray, s: np.ndarray, name: np.ndarray, anchor: np.ndarray, k: int, slack: float = 0.0) -> np.ndarray:
    """Which pairs are among the k most similar of an end that is an anchor, ties by name; with slack, those as similar as the k-th but for it, too."""
    end, other, pair = np.concatenate([i, j]), np.concatenate([j, i]), np.tile(np.arange(len(i)), 2)
    use = anchor[end]
    end, other, pair = end[use], other[use], pair[use]
    order = np.lexsort((name[other], -s[pair], end))
    end, pair = end[order], pair[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(end)), bool), end[1:] != end[:-1]]))
    length = np.diff(np.append(first, len(end)))
    kept = np.arange(len(end)) - np.repeat(first, length) < k
    if slack and len(end):
        kept |= s[pair] >= np.repeat(s[pair[first + np.minimum(k, length) - 1]], length) - slack
    out = np.zeros(len(i), bool)
    out[pair[kept]] = True
    return out


def _near(threshold: float, k: int, chunk: int = 1 << 21):
    """For mapInArrow, over the rows of whole blocks of groups: their similar pairs, a before b. Matrices have at most ``chunk`` numbers or a row."""

    def pairs(row: np.ndarray, v: np.ndarray, unit: np.ndarray, name: np.ndarray, own: np.ndarray, anchor: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
        two = not first[row].all()
        left = row[own[row]]
        found: list[tuple[np.ndarray, ...]] = []
        held = limit = 0
        step = max(1, chunk // len(row))
        for lo in range(0, len(left), step):
            some = left[lo : lo + step]
            i, j = np.nonzero(unit[some] @ unit[row].T >= threshold - _MARGIN)
            i, j = some[i], row[j]
            use = (name[i] != name[j]) & (~own[j] | (i < j)) & (anchor[i] | anchor[j])
            if two:
                use &= first[i] != first[j]
            i, j = i[use], j[use]
            s = np.concatenate([_cosine(v[i[at : at + 8192]], v[j[at : at + 8192]]) for at in range(0, len(i), 8192)] or [np.zeros(0)])
            use = s >= threshold
            found.append((i[use], j[use], s[use]))
            held += int(use.sum())
            if held > 2 * limit + chunk // 2 or lo + step >= len(left) and held > k:
                i, j, s = (np.concatenate(c) for c in zip(*found))
                kept = _best(i, j, s, name, anchor, k)
                found[:] = [(i[kept], j[kept], s[kept])]
                held = limit = int(kept.sum())
        return tuple(np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [x for x in batches if x.num_rows]
        if not held:
            return
        every = pa.Table.from_batches(held)
        held.clear()
        for kind_of in every.column("entity_type").unique().to_pylist():
            t = every.filter(pc.equal(every.column("entity_type"), kind_of))
            ids = t.column("entity_id").combine_chunks()
            names, name = np.unique(ids.to_numpy(zero_copy_only=False), return_inverse=True)
            g, h, x, y = (t.column(c).to_numpy() for c in "ghxy")
            own, anchor, first = (t.column(c).to_numpy() for c in ("own", "anchor", "first"))
            kinds, (v, unit) = t.column("kind").combine_chunks(), _vectors(t.column("embedding_vector"))
            order = np.lexsort((y, x, h, g))
            key = [c[order] for c in (g, h, x, y)]
            edges = np.flatnonzero(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in key], axis=0), [True]]))
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if hi - lo < 2:
                    continue
                i, j, s = pairs(order[lo:hi], v, unit, name, own, anchor, first)
                if len(i):
                    i, j = np.where(name[i] < name[j], i, j), np.where(name[i] < name[j], j, i)
                    columns = [pa.array(names[name[i]], pa.string()), pa.array(names[name[j]], pa.string()), pa.array([kind_of] * len(i), pa.string()), kinds.take(pa.array(i)), pa.array(s), pa.array(anchor[i]), pa.array(anchor[j])]
                    yield pa.RecordBatch.from_arrays(columns, ["a", "b", "entity_type", "kind", "similarity", "a_anchor", "b_anchor"])

    return run


def cosine_pairs(entities: DataFrame, anchors: DataFrame, threshold: float, best: int | None = None, block: int | None = None) -> DataFrame:
    """All pairs of entities of a type from the threshold on of which one at least is an anchor, once each: a, b, entity_type, similarity, a_anchor, b_anchor.

    Entities are numbered into blocks by hash and every two blocks are multiplied as matrices in one task: nothing is broadcast, and products of
    32 bits choose the pairs whose cosines are then worked out. There are few blocks (of ``block`` entities), as each entity is sent to all of them.
    With ``best``, only pairs are sent that may be among the so many most similar of an anchor, equal ones with them.
    """
    count = entities.count()
    n = max(1, -(-count // block) if block else max(-(-count // _WIDE), min(8, -(-count // 4096))))
    own = entities.select("entity_id", "entity_type", "embedding_vector", F.pmod(F.xxhash64("entity_id"), F.lit(n)).cast("int").alias("b"))
    marked = own.join(anchors.select("entity_id", "entity_type").distinct().withColumn("anchor", F.lit(True)), ["entity_id", "entity_type"], "left").withColumn("anchor", F.coalesce("anchor", F.lit(False)))
    met = marked.withColumn("to", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select("entity_id", "entity_type", "embedding_vector", "anchor", F.least("b", "to").alias("x"), F.greatest("b", "to").alias("y"), (F.col("b") <= F.col("to")).alias("first"))

    def multiply(t: pa.Table) -> pa.Table:
        ids, kind = t.column("entity_id").combine_chunks(), t.column("entity_type")[0].as_py()
        name = np.unique(ids.to_numpy(zero_copy_only=False), return_inverse=True)[1]
        anchor, first = t.column("anchor").to_numpy(), t.column("first").to_numpy()
        v, unit = _vectors(t.column("embedding_vector"))
        same = t.column("x")[0] == t.column("y")[0]
        left, right = np.flatnonzero(first), np.flatnonzero(first if same else ~first)
        found: list[tuple[np.ndarray, ...]] = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))]
        held = limit = 0
        # anchors with all, and what isn't one with the anchors of another block
        for a, b in ((left[anchor[left]], right), (left[~anchor[left]], right[anchor[right]] if not same else right[:0])):
            step = max(1, _CHUNK // max(1, len(b)))
            for lo in range(0, len(a) if len(b) else 0, step):
                some = a[lo : lo + step]
                i, j = np.nonzero(unit[some] @ unit[b].T >= threshold - _MARGIN)
                i, j = some[i], b[j]
                use = name[i] != name[j]
                if same:
                    use &= ~anchor[j] | (i < j)
                i, j = i[use], j[use]
                s = np.concatenate([_cosine(v[i[at : at + 8192]], v[j[at : at + 8192]]) for at in range(0, len(i), 8192)] or [np.zeros(0)])
                use = s >= threshold
                found.append((i[use], j[use], s[use]))
                held += int(use.sum())
                if best is not None and held > 2 * limit + _CHUNK // 2:
                    found[:] = [only(*(np.concatenate(c) for c in zip(*found)), name, anchor)]
                    held = limit = len(found[0][0])
        i, j, s = (np.concatenate(c) for c in zip(*found))
        if best is not None:
            i, j, s = only(i, j, s, name, anchor)
        return pa.table({"a": ids.take(pa.array(i)), "b": ids.take(pa.array(j)), "entity_type": pa.array([kind] * len(i), pa.string()), "similarity": s, "a_anchor": anchor[i], "b_anchor": anchor[j]})

    def only(i: np.ndarray, j: np.ndarray, s: np.ndarray, name: np.ndarray, anchor: np.ndarray) -> tuple[np.ndarray, ...]:
        kept = _best(i, j, s, name, anchor, best, _SLACK)
        return i[kept], j[kept], s[kept]

    return met.groupBy("entity_type", "x", "y").applyInArrow(multiply, "a string, b string, entity_type string, similarity double, a_anchor boolean, b_anchor boolean")


def _directed(pairs: DataFrame) -> DataFrame:
    """Pairs a, b with the columns a_anchor and b_anchor as anchor, other, once for each end that is an anchor."""
    ends = lambda x, y: F.struct(F.col(x).alias("anchor"), F.col(y).alias("other"), F.col(f"{x}_anchor").alias("use"))
    rest = [c for c in pairs.columns if c not in ("a", "b", "a_anchor", "b_anchor")]
    return pairs.select(F.explode(F.array(ends("a", "b"), ends("b", "a"))).alias("e"), *rest).where("e.use").select("e.anchor", "e.other", *rest)


def cosine_first(entities: DataFrame, anchors: DataFrame, threshold: float, best: int | None = None, block: int | None = None) -> DataFrame:
    """All pairs of an anchor and another entity of its type from the threshold on (:func:`cosine_pairs`): anchor, other, entity_type, similarity."""
    return _directed(cosine_pairs(entities, anchors, threshold, best, block))


def top_k(pairs: DataFrame, k: int) -> DataFrame:
    """The k most similar others of each anchor, ties by id."""
    w = W.partitionBy("entity_type", "anchor").orderBy(F.desc("similarity"), "other")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def candidates(entities: DataFrame, changed: DataFrame, settings: Blocking, everything: bool = False, plan: str = "gate") -> DataFrame:
    """Candidate pairs: an anchor (added or changed, or any where everything is asked for) and one of its top k gate-passing entities.

    The two plans give the same pairs: ``gate`` compares embeddings where evidence is shared, ``cosine`` compares all and then looks for evidence.
    """
    anchors = entities.select("entity_id", "entity_type") if everything else changed.where(F.col("delta_class").isin("added", "changed"))
    gated = gate_first(entities, anchors, settings)
    if plan == "cosine":
        alike = cosine_pairs(entities, anchors, settings.similarity_threshold).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "entity_type")
        near = gated.withColumns({"a": F.least("anchor", "other"), "b": F.greatest("anchor", "other")}).join(alike, ["a", "b", "entity_type"]).drop("a", "b")
    else:
        near = gated
    best = top_k(near, settings.max_candidates)
    a, b = F.least("anchor", "other"), F.greatest("anchor", "other")
    pairs = best.groupBy(a.alias("entity_a_id"), b.alias("entity_b_id"), "entity_type").agg(F.max("similarity").alias("embedding_similarity"), F.first("reasons").alias("candidate_reason_codes"))
    sources = entities.select("entity_id", "entity_type", "source_schema")
    for side in "ab":
        pairs = pairs.join(sources.select(F.col("entity_id").alias(f"entity_{side}_id"), "entity_type", F.col("source_schema").alias(f"source_schema_{side}")), [f"entity_{side}_id", "entity_type"])
    return conform(pairs.withColumn("pair_key", text.pair_key(F.col("entity_a_id"), F.col("entity_b_id"))), "candidates")


def overview(near: DataFrame, entities: DataFrame, anchors: DataFrame, settings: Blocking) -> DataFrame:
    """A row for each entity type and one for all: what the gate and the cap did to the pairs above the threshold.

    near has the pairs above the threshold (:func:`cosine_first`). Pairs of an anchor are examined in the order of their similarity until
    ``max_candidates`` of them pass the gate; what is left is truncated. Counts of failures are of examined pairs.
    """
    k = settings.max_candidates
    w = W.partitionBy("entity_type", "anchor").orderBy(F.desc("similarity"), "other")
    passed = (F.col("by_taxonomy") & F.col("by_other")).cast("int")
    ranked = judged(near, entities, settings.channels).withColumn("passed", passed).withColumn("before", F.coalesce(F.sum("passed").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    seen, kept = F.col("before") < k, (F.col("before") < k) & (F.col("passed") == 1)
    tax, other = F.col("by_taxonomy"), F.col("by_other")
    per = ranked.groupBy("entity_type", "anchor").agg(
        F.count_if(seen).alias("examined"), F.count_if(kept).alias("kept"), F.count_if(~seen).alias("truncated"), F.min(F.when(kept, F.col("similarity"))).alias("last"),
        F.count_if(seen & ~tax & other).alias("taxonomy_failed"), F.count_if(seen & tax & ~other).alias("non_taxonomy_failed"), F.count_if(seen & ~tax & ~other).alias("both_failed"),
    )
    pairs = ranked.where(kept).select("entity_type", F.least("anchor", "other").alias("a"), F.greatest("anchor", "other").alias("b")).distinct().groupBy("entity_type").agg(F.count("*").alias("pairs_kept"))
    own = anchors.select("entity_type", F.col("entity_id").alias("anchor")).distinct().join(per, ["entity_type", "anchor"], "left").na.fill(0, ["examined", "kept", "truncated", "taxonomy_failed", "non_taxonomy_failed", "both_failed"])
    counts = own.groupBy("entity_type").agg(
        F.count("*").alias("active_anchors"), F.count_if(F.col("examined") > 0).alias("anchors_with_above_threshold"), F.count_if(F.col("kept") > 0).alias("anchors_with_retained_candidates"),
        F.count_if(F.col("kept") >= k).alias("anchors_at_candidate_cap"), F.sum("examined").alias("above_threshold_examined"), F.sum("truncated").alias("truncated_above_threshold"),
        F.coalesce(F.sum("last"), F.lit(0.0)).alias("last_retained_similarity_sum"), F.count("last").alias("last_retained_similarity_count"), *[F.sum(c).alias(c) for c in ("taxonomy_failed", "non_taxonomy_failed", "both_failed")],
    ).join(pairs, "entity_type", "left").na.fill(0, ["pairs_kept"])
    numbers = [c for c in counts.columns if c != "entity_type"]
    total = counts.groupBy().agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in numbers]).select(F.lit("all").alias("entity_type"), *numbers)
    every = counts.select("entity_type", *numbers).unionByName(total)
    active, retained = F.col("active_anchors"), F.col("anchors_with_retained_candidates")
    every = every.withColumn("overlap_blocked", F.col("taxonomy_failed") + F.col("non_taxonomy_failed") + F.col("both_failed"))
    every = every.withColumn("no_above_threshold", active - F.col("anchors_with_above_threshold")).withColumn("above_threshold_but_no_retained", F.col("anchors_with_above_threshold") - retained)
    percent = {n: F.when(active > 0, F.round(100 * F.col(n) / active, 1)).otherwise(0.0) for n in ("no_above_threshold", "above_threshold_but_no_retained", "anchors_at_candidate_cap")}
    signals = (("no_above_threshold", "threshold_may_be_high"), ("above_threshold_but_no_retained", "overlap_prefilter_may_be_strict"), ("anchors_at_candidate_cap", "max_candidates_may_be_low"))
    said = F.concat_ws(",", *[F.when(percent[n] >= 20, F.lit(s)) for n, s in signals])
    return every.select(
        "*", F.coalesce(F.try_divide("last_retained_similarity_sum", "last_retained_similarity_count"), F.lit(0.0)).alias("avg_last_retained_similarity"), F.coalesce(F.try_divide("truncated_above_threshold", "anchors_at_candidate_cap"), F.lit(0.0)).alias("avg_truncated_per_capped"),
        *[c.alias(f"percent_{n}") for n, c in percent.items()], F.when(active <= 0, "no_active_anchors").when(said == "", "no_obvious_blocking_pressure").otherwise(said).alias("heuristic"),
    )


def embedding_uniqueness(entities: DataFrame) -> DataFrame:
    """Of each type: vectors of 8 numbers or more, how many differ in the first 8 rounded to 3 places, and the percentage that share theirs."""
    print_ = F.array_join(F.transform(F.slice("embedding_vector", 1, 8), lambda x: F.format_string("%.3f", F.round(x, 3) + 0.0)), ",")
    own = entities.where(F.size("embedding_vector") >= 8).groupBy("entity_type", print_.alias("p")).agg(F.count("*").alias("n"))
    total, unique = F.sum("n"), F.count("*")
    return own.groupBy("entity_type").agg(total.alias("total"), unique.alias("unique_embeddings"), F.round(100 * (1 - unique / total), 1).alias("shared_percent"))


__all__ = ["EVALUATORS", "candidates", "cosine_first", "cosine_pairs", "embedding_uniqueness", "empty", "gate_first", "judged", "overview", "top_k"]
