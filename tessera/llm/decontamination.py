"""Operator 4: benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

A mask is a fixed list of token offsets; the tokens between them are ignored, so that a
seed hits across substituted tokens. Every token position of every document and of every
benchmark item is hashed under every mask, the hashes are joined, and around each hit the
document is aligned with the item, token by token: the best run of the alignment, a match
counting +1 and a substitution -1, must have ``min_score``, or all but one in
``PER_SUBSTITUTION`` of the item's tokens must match. The three masks find every passage of
11 tokens with one substitution anywhere, of 14 with 2, of 18 with 3, of 22 with 4 and of
27 with 5 (all cases were tried), and from 14 tokens on all of these have the score. An item
of 7 to 10 tokens is looked for by its two halves, a shorter one as a whole.

Shape at scale: the seeds of a document are made and joined inside one stage of generated
code. Hits that follow one another in one alignment leave it as one row, with the part of
the document that lies beside the item, so a text that repeats itself costs no more than
its alignments. Those rows are the only ones shuffled; texts never are. The benchmark's
seeds are broadcast in blocks of a bounded number of tokens; a benchmark beyond one block
means another pass over the documents for each block.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import durable, whole_text

#: Fixed offsets of the tokens that each mask looks at.
MASKS = ((0, 1, 2, 3, 4, 5), (0, 1, 3, 6, 8, 9), (0, 2, 3, 7, 9, 10))
#: Items of fewer tokens are no evidence and match nothing.
MIN_TOKENS = 5
MIN_SCORE = 10
MISMATCH = 1
#: So many tokens of an item allow one substitution.
PER_SUBSTITUTION = 7
#: Benchmark tokens whose seeds are broadcast at a time (under 40 MB).
BLOCK_TOKENS = 100_000
TOKEN_BREAK = r"[^\p{L}\p{N}]+"


def tokens(column: str) -> Column:
    """Lower-case runs of letters and digits."""
    return F.array_remove(F.split(F.lower(whole_text(column)), TOKEN_BREAK), "")


def _short(n: int) -> tuple[int, tuple[int, ...]]:
    """Of an item of n tokens, fewer than the longest mask has: the length of its seeds and where in it they start."""
    return (n, (0,)) if n < PER_SUBSTITUTION else (n // 2, (0, n - n // 2))


def _masks(lengths: list[int]) -> dict[int, tuple[int, ...]]:
    """The masks by number; runs of tokens for short items come after the others."""
    return dict(enumerate(MASKS)) | {len(MASKS) + k: tuple(range(k)) for k in sorted({_short(n)[0] for n in lengths})}


def _seed(name: int, mask: tuple[int, ...], pos: Column) -> Column:
    """The hash of the seed that starts at token ``pos`` of ``words``; of fewer tokens, so that no whole seed equals it, where the mask doesn't fit."""
    return F.xxhash64(F.lit(name), *[F.get("words", pos + k) for k in mask])


def _seeded(rows: DataFrame, masks: dict[int, tuple[int, ...]], *keep: str) -> DataFrame:
    # The outer form keeps the optimizer from testing the size of the words first, which would cut the text twice.
    placed = rows.select(*keep, "words", F.posexplode_outer("words").alias("pos", "word"))
    return placed.select(*keep, "words", "pos", F.explode(F.array(*[_seed(name, mask, F.col("pos")) for name, mask in masks.items()])).alias("seed"))


def _item_seeds(items: DataFrame, masks: dict[int, tuple[int, ...]]) -> DataFrame:
    """(seed, mask, offsets, item_no, before, places): ``before`` is the seed of the same mask one token before each of the places.

    Short items have seeds at their own places only, and none before them.
    """
    placed = items.select("item_no", F.col("item_words").alias("words"), F.posexplode("item_words").alias("pos", "word"))
    pos, n = F.col("pos"), F.size("words")
    longest = max(m[-1] for m in MASKS) + 1
    made = []
    for name, mask in masks.items():
        offsets = F.array(*map(F.lit, mask)).alias("offsets")
        if name < len(MASKS):
            here = F.when(pos + mask[-1] < n, _seed(name, mask, pos))
            before = F.when(pos > 0, _seed(name, mask, pos - 1))
        else:
            at = [(n == k) & pos.isin(list(_short(k)[1])) for k in range(MIN_TOKENS, longest) if _short(k)[0] == len(mask)]
            here = F.when(reduce(Column.__or__, at), _seed(name, mask, pos))
            before = F.lit(None).cast("bigint")
        made.append(F.struct(here.alias("seed"), F.lit(name).alias("mask"), offsets, before.alias("before")))
    seeds = placed.select("item_no", F.col("pos").alias("item_pos"), F.inline(F.array(*made)))
    return seeds.where("seed is not null").groupBy("seed", "mask", "offsets", "item_no", "before").agg(F.collect_list("item_pos").alias("places"))


def _best_run(pairs: Column) -> Column:
    """Of aligned (a, b) tokens: score, matches and length of the best run, and all matches, as a struct."""
    zero = F.struct(*[F.lit(0).alias(c) for c in ("run", "hits", "len", "score", "matched", "length", "same")])

    def step(s, same):
        run = F.when(same, s["run"] + 1).otherwise(s["run"] - MISMATCH)
        alive = run > 0
        hits, length = s["hits"] + same.cast("int"), s["len"] + 1
        better = run > s["score"]
        pick = lambda yes, no: F.when(better, yes).otherwise(no)
        return F.struct(
            F.when(alive, run).otherwise(0).alias("run"),
            F.when(alive, hits).otherwise(0).alias("hits"),
            F.when(alive, length).otherwise(0).alias("len"),
            pick(run, s["score"]).alias("score"),
            pick(hits, s["matched"]).alias("matched"),
            pick(length, s["length"]).alias("length"),
            (s["same"] + same.cast("int")).alias("same"),
        )

    return F.aggregate(pairs, zero, step)


def benchmark_items(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, n_equal, item_words) of each different item of at least MIN_TOKENS tokens."""
    worded = benchmark.select(F.col(item_col).cast("bigint").alias("item"), tokens(text_col).alias("item_words")).where(F.size("item_words") >= MIN_TOKENS)
    return worded.groupBy("item_words").agg(F.min("item").alias("item"), F.count(F.lit(1)).alias("n_equal")).select("item", "n_equal", "item_words")


def contaminated(docs: DataFrame, benchmark: DataFrame, min_score: int = MIN_SCORE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document and benchmark item that overlap.

    Columns: ``id_col``, ``item_col`` (the least id of items with equal tokens),
    n_equal_items, score, matched and overlap (tokens of the best run), item_tokens and
    doc_token (where in the document the item's first token would be; negative if before
    it). An item of fewer than 14 tokens must match whole but for one token, one of fewer
    than 7 whole. Null and empty texts overlap nothing; several documents of one id give
    one row; items of equal tokens count as one; an empty table on either side gives no
    rows. Other columns are ignored.
    """
    items = durable(benchmark_items(benchmark, item_col, item_text_col).withColumn("item_no", F.monotonically_increasing_id()))
    sizes = items.agg(F.coalesce(F.sum(F.size("item_words")), F.lit(0))).first()[0]
    longest = max(m[-1] for m in MASKS) + 1
    masks = _masks([r[0] for r in items.where(F.size("item_words") < longest).select(F.size("item_words")).distinct().collect()])
    blocks = max(1, -(-sizes // BLOCK_TOKENS))
    worded = docs.select(F.col(id_col).alias("doc"), F.xxhash64(whole_text(text_col)).alias("text_hash"), tokens(text_col).alias("words"))
    found = reduce(DataFrame.unionByName, [_hits(worded, items.where(F.pmod(F.xxhash64("item_no"), F.lit(blocks)) == b), masks, min_score) for b in range(blocks)])
    best = found.groupBy("doc", "item").agg(F.max(F.struct("score", "matched", F.negative("shift").alias("shift"), "overlap", "n_equal", "item_tokens")).alias("x"))
    return best.select(
        F.col("doc").alias(id_col),
        F.col("item").alias(item_col),
        F.col("x.n_equal").alias("n_equal_items"),
        F.col("x.score").alias("score"),
        F.col("x.matched").alias("matched"),
        F.col("x.overlap").alias("overlap"),
        F.col("x.item_tokens").alias("item_tokens"),
        F.negative("x.shift").alias("doc_token"),
    )


def _hits(worded: DataFrame, items: DataFrame, masks: dict[int, tuple[int, ...]], min_score: int) -> DataFrame:
    met = _seeded(worded, masks, "doc", "text_hash").join(F.broadcast(_item_seeds(items, masks)), "seed")
    # Of hits of one mask that follow one another in one alignment the first is enough. The test is short, as
    # the compiler of the JVM leaves methods of more than 8,000 bytes as they are.
    before = F.xxhash64("mask", *[F.get("words", F.col("pos") - 1 + F.get("offsets", F.lit(k))) for k in range(len(MASKS[0]))])
    met = met.where(F.col("before").isNull() | (before != F.col("before")))
    met = met.select("doc", "text_hash", "words", "pos", "item_no", F.explode("places").alias("item_pos")).join(F.broadcast(items.select("item_no", F.size("item_words").alias("n_item"))), "item_no")
    shift = F.col("pos") - F.col("item_pos")
    skip, at = F.greatest(F.lit(0), -shift), F.greatest(F.lit(0), shift)
    part = F.slice("words", at + 1, F.least(F.size("words") - at, F.col("n_item") - skip))
    aligned = met.select("doc", "text_hash", "item_no", shift.alias("shift"), part.alias("part")).groupBy("doc", "text_hash", "item_no", "shift").agg(F.first("part").alias("part"))
    aligned = aligned.join(F.broadcast(items), "item_no")
    own = F.slice("item_words", F.greatest(F.lit(0), F.negative("shift")) + 1, F.size("part"))
    n = F.size("item_words")
    met = aligned.withColumn("run", _best_run(F.zip_with("part", own, lambda a, b: a == b)))
    enough = (F.col("run.score") >= min_score) | (F.col("run.same") >= n - F.floor(n / PER_SUBSTITUTION))
    return met.where(enough).select("doc", "item", "n_equal", "shift", F.col("run.score").alias("score"), F.col("run.matched").alias("matched"), F.col("run.length").alias("overlap"), n.alias("item_tokens"))


def contaminated_sql(docs: str = "documents", benchmark: str = "benchmark") -> str:
    """The same rows as DuckDB SQL: seeds as joined words, and the best run by running minima of prefix sums."""
    longest = max(m[-1] for m in MASKS) + 1
    masks = _masks(list(range(MIN_TOKENS, longest)))
    shorts = {k: [n for n in range(MIN_TOKENS, longest) if _short(n)[0] == k] for k in {_short(n)[0] for n in range(MIN_TOKENS, longest)}}
    tokens_of = "list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')"

    def seeds(source: str, keep: str) -> str:
        parts = []
        for k, mask in masks.items():
            key = " || ' ' || ".join(f"ws[p + {o}]" for o in mask)
            lengths = shorts.get(len(mask), []) if k >= len(MASKS) else []
            short = f" AND EXISTS (SELECT 1 FROM items WHERE len(ws) IN {(*lengths, 0)})" if lengths else ""
            if lengths and source == "at_i":
                short = " AND (" + " OR ".join(f"len(ws) = {n} AND p - 1 IN {(*_short(n)[1], -1)}" for n in lengths) + ")"
            parts.append(f"SELECT {keep}, p, {k} AS mask, {key} AS key FROM {source} WHERE p + {mask[-1]} <= len(ws){short}")
        return " UNION ALL ".join(parts)

    return f"""
WITH texts AS (SELECT DISTINCT doc_id, {tokens_of} AS ws FROM {docs}),
items AS (SELECT min(item_id) AS item, count(*) AS n_equal, ws FROM (SELECT item_id, {tokens_of} AS ws FROM {benchmark}) WHERE len(ws) >= {MIN_TOKENS} GROUP BY ws),
at_d AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS p FROM texts),
at_i AS (SELECT item, ws, unnest(range(1, len(ws) + 1)) AS p FROM items),
seed_d AS ({seeds("at_d", "doc_id, ws")}),
seed_i AS ({seeds("at_i", "item")}),
met AS (SELECT DISTINCT d.doc_id, d.ws, i.item, d.p - i.p AS shift FROM seed_d d JOIN seed_i i ON d.mask = i.mask AND d.key = i.key),
cells AS (
  SELECT doc_id, m.ws AS ws, i.item, n_equal, shift, len(i.ws) AS item_tokens, k, CASE WHEN m.ws[k + shift] = i.ws[k] THEN 1 ELSE -{MISMATCH} END AS s
  FROM met m JOIN items i ON m.item = i.item, LATERAL (SELECT unnest(range(greatest(1, 1 - shift), least(len(i.ws), len(m.ws) - shift) + 1)) AS k) x),
sums AS (SELECT *, count(*) FILTER (WHERE s = 1) OVER (PARTITION BY doc_id, ws, item, shift) AS same, sum(s) OVER (PARTITION BY doc_id, ws, item, shift ORDER BY k) AS total, row_number() OVER (PARTITION BY doc_id, ws, item, shift ORDER BY k) AS n FROM cells),
lows AS (SELECT *, least(0, coalesce(min(total) OVER (PARTITION BY doc_id, ws, item, shift ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS low FROM sums),
runs AS (
  SELECT *, total - low AS run, n - coalesce(max(CASE WHEN total <= low THEN n END) OVER (PARTITION BY doc_id, ws, item, shift ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS length FROM lows),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, ws, item, shift ORDER BY run DESC, k) AS place FROM runs),
scored AS (
  SELECT doc_id, item, n_equal, shift, item_tokens, CAST(run AS INT) AS score, CAST((run + {MISMATCH} * length) / {1 + MISMATCH} AS INT) AS matched, CAST(length AS INT) AS overlap
  FROM best WHERE place = 1 AND (run >= {MIN_SCORE} OR same >= item_tokens - item_tokens // {PER_SUBSTITUTION})),
top AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item ORDER BY score DESC, matched DESC, shift, overlap DESC) AS place FROM scored)
SELECT doc_id, item AS item_id, n_equal AS n_equal_items, score, matched, overlap, CAST(item_tokens AS INT) AS item_tokens, CAST(shift AS INT) AS doc_token FROM top WHERE place = 1
"""
