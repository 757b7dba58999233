"""Chat formatting: token-level assembly.

Role and text of each turn are encoded apart from each other; reserved ids, which no encoding of text yields, are spliced
around them; the loss mask is the prefix sum of +1 where an assistant text begins and -1 where it ends. Control strings
occurring in a text are escaped, so that the template's text form is unambiguous too:

    <s>  then per turn  [INST] role [/INST] text </s>     (without the blanks)

An escape character is put after the first character of a control string, and doubled where it stands in a text itself.

Texts are encoded before the shuffle, so one large conversation costs its task only the assembly, which streams over the
sorted turns and never holds a conversation.

Defined results: null role and null text are empty strings; null conv_id is a conversation of its own; turns go by turn
(nulls first), ties by role and encoded text; repeated rows are repeated turns; an empty table gives no rows; extra columns
are not read.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, table, to_batch, _arrow_schema

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
# The split pattern that this public vocabulary was trained with.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BOS, EOS, HEAD, BODY = "<s>", "</s>", "[INST]", "[/INST]"
CONTROL = (BOS, EOS, HEAD, BODY)
ESCAPE = "␛"
_ESCAPING = re.compile("|".join(re.escape(x) for x in (ESCAPE, *sorted(CONTROL, key=len, reverse=True))))
_ESCAPED = re.compile(f"{ESCAPE}({ESCAPE}?)")


def escape(text: str) -> str:
    return _ESCAPING.sub(lambda m: m[0][0] + ESCAPE + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


@lru_cache(maxsize=4)
def encoding(tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY):
    """The encoder, and the first of the reserved ids (in the order of CONTROL), which lie past the vocabulary."""
    import tiktoken

    with open(f"{tokenizers}/{vocabulary}", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    # a long run of letters is cut into pieces below: encoding time grows with the square of a piece
    return tiktoken.Encoding(vocabulary, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), max(ranks.values()) + 1


def encode(text: str, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> list[int]:
    """Ids of the escaped text. Texts over 100,000 characters go in slices, whose ids join to the same text."""
    enc = encoding(tokenizers, vocabulary)[0]
    text = escape(text)
    return [i for at in range(0, len(text), 100_000) for i in enc.encode_ordinary(text[at : at + 100_000])]


SEGMENTS = "conv_id long, turn long, position long, token_start long, ids array<int>, loss_mask array<int>"


def format_conversations(conversations: DataFrame, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """Per turn: its ids with the spliced reserved ones, its loss mask, and where in its conversation they begin.

    Rows stay sorted by conversation and position within their partition, and a conversation lies in one partition."""
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )

    def encoded(batch):
        text = [encode(t, tokenizers, vocabulary) for t in batch.column("text").to_pylist()]
        role = [encode(t, tokenizers, vocabulary) for t in batch.column("role").to_pylist()]
        yield {"conv_id": batch.column("conv_id"), "turn": batch.column("turn"), "role": batch.column("role"), "role_ids": role, "text_ids": text}

    kept = arrow_map(rows, encoded, "conv_id long, turn long, role string, role_ids array<int>, text_ids array<int>")
    kept = kept.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text_ids")
    schema = _arrow_schema(SEGMENTS)

    def assembled(batches):
        first = encoding(tokenizers, vocabulary)[1]
        bos, eos, head, body = range(first, first + 4)
        conv, position, start, begun = None, 0, 0, False
        for batch in batches:
            out = {f.name: [] for f in schema}
            columns = (batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "role_ids", "text_ids"))
            for c, turn, role, role_ids, text_ids in zip(*columns):
                if not begun or c != conv:
                    conv, position, start, begun = c, 0, 0, True
                ids = [bos] * (position == 0) + [head, *role_ids, body, *text_ids, eos]
                step = np.zeros(len(ids) + 1, np.int32)
                if role == "assistant":
                    step[len(ids) - 1 - len(text_ids)] += 1
                    step[len(ids) - 1] -= 1
                for name, v in zip(out, (c, turn, position, start, ids, np.cumsum(step[:-1]))):
                    out[name].append(v)
                position, start = position + 1, start + len(ids)
            yield to_batch(out, schema)

    return kept.mapInArrow(assembled, SEGMENTS)


def digest(segments: DataFrame, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """Per conversation, what its ids and mask say when read back. segments: as format_conversations() returns them."""
    ddl = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, n_loss_tokens long"
    schema = _arrow_schema(ddl)

    class State:
        def __init__(self, conv):
            self.conv, self.turns, self.turns_hash, self.loss, self.loss_hash = conv, 0, sha256(), 0, sha256()
            self.chars = self.tokens = self.loss_tokens = 0

        def row(self):
            return (self.conv, self.turns, self.turns_hash.hexdigest(), self.loss, self.loss_hash.hexdigest(), self.chars, self.tokens, self.loss_tokens)

    def read(batches):
        enc, first = encoding(tokenizers, vocabulary)
        table_ = dict(enumerate(CONTROL, first))
        state = None
        text_of = lambda ids: enc.decode_bytes(ids).decode("utf-8")
        for batch in batches:
            rows = []
            for conv, position, ids, mask in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "position", "ids", "loss_mask"))):
                if position == 0:
                    if state:
                        rows.append(state.row())
                    state = State(conv)
                at = [i for i, x in enumerate(ids) if x >= first]
                head, body, end = at[-3:]
                role, text = text_of(ids[head + 1 : body]), text_of(ids[body + 1 : end])
                state.turns_hash.update(f"{unescape(role)}\n{unescape(text)}\n".encode())
                under = [x for x, m in zip(ids, mask) if m]
                loss = unescape(text_of(under))
                state.loss_hash.update(loss.encode())
                state.turns += 1
                state.loss += len(loss)
                state.chars += len(role) + len(text) + sum(len(table_[ids[i]]) for i in at)
                state.tokens += len(ids)
                state.loss_tokens += len(under)
            if rows:
                yield to_batch(dict(zip(schema.names, map(list, zip(*rows)))), schema)
        if state:
            yield to_batch({n: [v] for n, v in zip(schema.names, state.row())}, schema)

    return segments.mapInArrow(read, ddl)


PROBE = "</s>[INST] ok [/INST]"


def op3_chat_format(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    return digest(format_conversations(rows.unionByName(probe))).drop("n_tokens", "n_loss_tokens")


def _escaped_length(column: str) -> str:
    found = [f"(length({column}) - length(replace({column}, '{x}', ''))) // {len(x)}" for x in (ESCAPE, *CONTROL)]
    return f"length({column}) + " + " + ".join(found)


ORACLE = f"""
WITH rows AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE}'
), said AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role) AS turns,
         coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST) FILTER (role = 'assistant'), '') AS loss,
         sum({len(HEAD + BODY + EOS)} + {_escaped_length("role")} + {_escaped_length("text")}) AS chars
  FROM rows GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
       CAST({len(BOS)} + chars AS BIGINT) AS formatted_chars
FROM said
"""
