"""Corpus vocabulary and fixed-length token-id encoding (re-aimed tokenizer).

Tokens are lower-cased Unicode word runs or single non-space symbols. Ids:
specials first, then tokens by (count desc, token asc). Encoding truncates to
``max_length`` and pads right or left, to ``max_length`` or to the longest row
of a batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .rank import ROW, global_row_number, numbered, written

# Token pattern, special tokens and their ids, ignored label id.
TOKEN_PATTERN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
SPECIALS = ["[PAD]", "[UNK]"]
PAD_ID, UNK_ID = 0, 1
IGNORE_ID = -100
# Tokens that every task holds, and their longest: 4 MB of text at most.
FREQUENT, FREQUENT_BYTES = 1 << 16, 64


def tokens(col) -> "F.Column":
    c = F.col(col) if isinstance(col, str) else col
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(TOKEN_PATTERN), 0)


def vocabulary(df: DataFrame, text_col: str = "text", min_count: int = 1, max_size: int | None = None) -> DataFrame:
    """(token, id, count). Counting is a partial aggregation; the id order is an
    exact global rank cut into ranges by (count, first 4 token bytes), so ties on
    a common count never land in one task."""
    from ..session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    # the counts feed the range sketch and the ranking: written once to the
    # shared checkpoint folder so the corpus is tokenized once, not per pass
    counts = (df.select(F.explode(tokens(text_col)).alias("token")).groupBy("token")
              .agg(F.count(F.lit(1)).alias("count")).where(F.col("count") >= min_count)
              .checkpoint(eager=True))
    prefix = F.conv(F.rpad(F.hex(F.substring(F.encode("token", "UTF-8"), 1, 4)), 8, "0"), 16, 10).cast("double")
    keyed = counts.withColumn("_bk", -F.col("count").cast("double") * 4294967296.0 + prefix)
    ranked = global_row_number(keyed, "_bk", [F.col("count").desc(), F.col("token").asc()], out="_rn")
    vocab = ranked.select("token", (F.col("_rn") - 1 + len(SPECIALS)).alias("id"), "count")
    if max_size is not None:
        vocab = vocab.where(F.col("id") < max_size)
    # an artifact read by every encoding pass: written once to the shared
    # checkpoint folder instead of re-ranked per use
    return vocab.checkpoint(eager=True)


def frequent_tokens(vocab: DataFrame, most: int = FREQUENT) -> list[tuple[str, int]]:
    """(token, id) of the most frequent tokens of at most ``FREQUENT_BYTES`` bytes: what every task holds is
    bounded by their product, whatever the vocabulary."""
    short = vocab.where((F.col("id") < most + len(SPECIALS)) & (F.octet_length("token") <= FREQUENT_BYTES))
    return [(r["token"], r["id"]) for r in short.select("token", "id").collect()]


def token_ids(df: DataFrame, vocab: DataFrame, text_col: str = "text", id_col: str = "row_id", max_length: int = 256,
              frequent: int = FREQUENT) -> DataFrame:
    """Adds ``_ids``, the unpadded ids of the first ``max_length`` tokens.

    The frequent tokens are looked up in place, a batch at a time; only the others are shuffled, each once a row,
    and AQE splits one that is hot. Rows are told apart by a number of their own (``id_col`` plays no part), and
    texts take part in no shuffle unless the caller keeps their column."""
    rows = numbered(df)
    common = frequent_tokens(vocab, frequent)
    whole = len(common) == vocab.count()  # then a token that is not found is unknown
    shared = df.sparkSession.sparkContext.broadcast((pa.array([t for t, _ in common], pa.string()), np.array([i for _, i in common] + [UNK_ID], np.int32)))
    toks = rows.select(ROW, F.slice(tokens(text_col), 1, max_length).alias("toks"))

    def run(batches):
        words, ids = shared.value
        for batch in batches:
            lists = batch.column("toks")
            found = pc.index_in(lists.flatten(), value_set=words)
            at = np.asarray(found.fill_null(len(words)))
            sizes = np.asarray(lists.value_lengths())
            ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            mask = np.zeros(len(at), bool) if whole else at == len(words)
            rare, place = np.flatnonzero(mask), np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            per_row = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[rare], minlength=len(sizes))
            rare_ends = pa.array(np.concatenate([[0], np.cumsum(per_row)]), pa.int32())
            missing = pa.StructArray.from_arrays([pa.array(place[rare].astype(np.int32)), lists.flatten().take(pa.array(rare))], ["pos", "token"])
            yield pa.RecordBatch.from_arrays(
                [batch.column(ROW), pa.ListArray.from_arrays(ends, pa.array(ids[at])), pa.ListArray.from_arrays(rare_ends, missing)], [ROW, "_ids", "_rare"])

    coded = toks.mapInArrow(run, f"{ROW} bigint, _ids array<int>, _rare array<struct<pos:int,token:string>>")
    if not whole:
        coded = written(coded, "coded")
        seen = coded.select(ROW, F.explode("_rare").alias("r")).groupBy(ROW, "r.token").agg(F.collect_list("r.pos").alias("at"))
        # no hint: the planner chooses by bytes, AQE splits a hot token's partition
        late = (seen.join(vocab.select("token", F.col("id").cast("int").alias("id")), "token").groupBy(ROW)
                .agg(F.map_from_entries(F.flatten(F.collect_list(F.transform("at", lambda p: F.struct(p, F.col("id")))))).alias("_late")))
        patched = F.transform("_ids", lambda x, i: F.coalesce(F.element_at("_late", i), x))
        coded = coded.join(late, ROW, "left").withColumn("_ids", F.when(F.col("_late").isNotNull(), patched).otherwise(F.col("_ids"))).drop("_late")
    return rows.join(coded.drop("_rare"), ROW).drop(ROW)


def padded(ids, length, padding: str = "right"):
    """(input_ids, attention_mask) of an id array filled up to ``length``."""
    ids, length = (F.col(x) if isinstance(x, str) else x for x in (ids, length))
    fill = length - F.size(ids)
    parts = [(ids, F.array_repeat(F.lit(PAD_ID), fill)), (F.array_repeat(F.lit(1), F.size(ids)), F.array_repeat(F.lit(0), fill))]
    return tuple(F.concat(*(p if padding == "right" else p[::-1])) for p in parts)


def encode_tokens(df: DataFrame, vocab: DataFrame, text_col: str = "text", id_col: str = "row_id",
                  max_length: int = 256, padding: str = "right", pad_to: str = "max_length",
                  batch_col: str | None = None) -> DataFrame:
    """Adds ``input_ids`` and ``attention_mask`` (int arrays). ``pad_to='longest'``
    pads to the longest row of ``batch_col`` (a bounded batch), else to max_length."""
    out = token_ids(df, vocab, text_col, id_col, max_length)
    n = F.size("_ids")
    if pad_to == "longest" and batch_col:
        length = F.max(n).over(Window.partitionBy(batch_col))  # batches are bounded
    elif pad_to == "longest":
        length = out.select(F.max(F.size("_ids"))).scalar()  # one global max, no window
    else:
        length = F.lit(max_length)
    out = out.withColumn("_L", length)
    ids, mask = padded("_ids", "_L", padding)
    return out.withColumns({"input_ids": ids, "attention_mask": mask}).drop("_ids", "_L")


def align_target_labels(target_ids, length: int):
    """Target ids right-aligned into a row of -100 of the input length."""
    from ..functions.arrays import align_target_labels as _align
    return _align(target_ids, length)
