"""Chat formatting by token-level assembly.

Every segment (a turn's role, a turn's text) is escaped and encoded on its own,
so no token crosses a segment. Reserved ids, which no text can encode to, are
spliced between the segments; a prefix sum over segment lengths gives each
segment's place in its conversation and so the loss mask.

A conversation in tokens is, per turn: TURN role TEXT text END. Its printed
form writes the reserved ids as the control strings below. Where content holds
a control string, a backslash goes before it, and backslashes are doubled, so
the printed form can be read back too.

Output is one row per segment, sorted within its conversation, so that one
conversation of any length streams through its task; `conversations_of` joins
them to arrays where conversations are known to be short.

Cases: a null text or role counts as empty; rows with one turn number keep a
fixed order (role, then text); repeated rows are turns of their own; a null
conv_id is a conversation of its own; no rows give no rows. Extra columns are
ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, table

#: Ids above the vocabulary's 50,256 ranks and its one special id.
TURN, TEXT, END = 50257, 50258, 50259
#: How the reserved ids print. Fixed values; the escape knows them.
PRINTED = {TURN: "<turn>", TEXT: "<text>", END: "</turn>\n"}
CONTROL = re.compile(r"\\|(?=</?turn>|<text>)")
ESCAPED = re.compile(r"\\([\\<])")
#: Roles whose text is under the loss mask.
LEARNED = ("assistant",)


def escape(text: str) -> str:
    """Double each backslash; put one before each control string."""
    return CONTROL.sub(lambda m: "\\\\" if m[0] else "\\", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def vocabulary_path() -> str:
    """Default place of the rank file; a parameter everywhere below."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@functools.lru_cache(maxsize=2)
def encoder(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("chat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoded_turns(rows: DataFrame, vocabulary: str, learned=LEARNED) -> DataFrame:
    """conv_id, turn, role, text, ids, mask_from, mask_to: a turn's tokens and the part of them that is learned."""

    def encode(batches):
        e = encoder(vocabulary)
        for b in batches:
            ids, start, stop = [], [], []
            for role, text in zip(b.column("role").to_pylist(), b.column("text").to_pylist(), strict=True):
                head = [TURN, *e.encode_ordinary(escape(role)), TEXT]
                body = e.encode_ordinary(escape(text))
                ids.append([*head, *body, END])
                start.append(len(head))
                stop.append(len(head) + (len(body) if role in learned else 0))
            more = [pa.array(ids, pa.list_(pa.int32())), pa.array(start, pa.int64()), pa.array(stop, pa.int64())]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], names=[*b.schema.names, "ids", "mask_from", "mask_to"])

    bounded_batches(rows.sparkSession)
    turns = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return turns.mapInArrow(encode, "conv_id long, turn long, role string, text string, ids array<int>, mask_from long, mask_to long")


def assembled(rows: DataFrame, vocabulary: str | None = None, learned=LEARNED) -> DataFrame:
    """conv_id, nth, start, ids, mask_from, mask_to: the turns of each conversation in place.

    start is the number of tokens before the turn in its conversation, by a
    prefix sum; the learned tokens stand from mask_from up to mask_to, counted
    like start from the conversation's first token.
    """
    t = encoded_turns(rows, vocabulary or vocabulary_path(), learned)
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.size("ids").cast("long")).over(before), F.lit(0))
    placed = t.select("conv_id", F.row_number().over(order).alias("nth"), start.alias("start"), "ids", "mask_from", "mask_to")
    return placed.select("conv_id", "nth", "start", "ids", *[(F.col("start") + F.col(c)).alias(c) for c in ("mask_from", "mask_to")])


def conversations_of(segments: DataFrame) -> DataFrame:
    """conv_id, input_ids, loss_mask: a row per conversation, for conversations that fit a row."""
    mask = F.transform("ids", lambda x, i: F.when((F.col("start") + i >= F.col("mask_from")) & (F.col("start") + i < F.col("mask_to")), 1).otherwise(0))
    whole = segments.withColumn("mask", mask).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("start", "ids", "mask"))).alias("parts"))
    return whole.select("conv_id", F.flatten("parts.ids").alias("input_ids"), F.flatten("parts.mask").alias("loss_mask"))


def read_back(ids: list[int], decode) -> tuple[str, str]:
    """Role and text of one turn's tokens."""
    if ids[0] != TURN or ids[-1] != END:
        raise ValueError("not a turn")
    cut = ids.index(TEXT)
    return unescape(decode(ids[1:cut])), unescape(decode(ids[cut + 1 : -1]))


def digests(segments: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """A row per conversation, read back from its tokens.

    The segments of a conversation come in order (the prefix sum's sort) and
    stream through running digests: nothing is gathered, however long it is.
    What the mask covers is found at the places that the prefix sums give, in
    the tokens as they come.
    """
    path = vocabulary or vocabulary_path()

    def stream(batches):
        e = encoder(path)
        at, row, seen = object(), None, 0

        def done():
            return {"conv_id": at, "n_turns": row[0], "turns_sha256": row[1].hexdigest(), "loss_chars": row[2], "loss_sha256": row[3].hexdigest(), "formatted_chars": row[4]}

        for b in batches:
            out = []
            for conv, ids, lo, hi in zip(*(b.column(c).to_pylist() for c in ("conv_id", "ids", "mask_from", "mask_to")), strict=True):
                if conv != at or row is None:
                    if row is not None:
                        out.append(done())
                    at, row, seen = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0], 0
                role, text = read_back(ids, e.decode)
                learned = unescape(e.decode(ids[max(lo - seen, 0) : max(hi - seen, 0)]))
                seen += len(ids)
                row[0] += 1
                row[1].update(f"{role}\n{text}\n".encode())
                row[2] += len(learned)
                row[3].update(learned.encode())
                cut = ids.index(TEXT)
                row[4] += sum(map(len, PRINTED.values())) + len(e.decode(ids[1:cut])) + len(e.decode(ids[cut + 1 : -1]))
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
        if row is not None:
            yield pa.RecordBatch.from_pylist([done()], schema)

    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    ordered = segments.repartition("conv_id").sortWithinPartitions("conv_id", "nth")
    return ordered.mapInArrow(stream, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op6_chat(spark, sf_dir: str) -> DataFrame:
    says = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", says), (-7, 1, "assistant", says)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return digests(assembled(rows))


def oracle_sql() -> str:
    escaped = lambda c: f"regexp_replace(replace({c}, chr(92), chr(92) || chr(92)), '(</?turn>|<text>)', chr(92) || chr(92) || '\\1', 'g')"
    return f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, v.turn, v.role, chr(92) || '### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(turn, role))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(20 + length({escaped("role")}) + length({escaped("text")})) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""
