"""Token counts by whole-token look-up: words proven to be one token are counted, only the rest are merged."""

from __future__ import annotations

import functools
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import file_bytes, on_bytes
from sightline.llm.merging import Memo, Merges

# ---------------------------------------------------------------------------------------- Fixed values
SPACE = "▁"          # how the vocabulary writes a space
#: Rules to cut a text into pre-tokens, finest first. The first one that the vocabulary proves is used.
CUTS = (
    # Letters, or other signs, each with the spaces before; line ends and digits alone.
    f"{SPACE}*[^\\W\\d_\xb2\xb3\xb9\xbc-\xbe]+|{SPACE}*(?:(?![{SPACE}\\n0-9])[\\W\\d_\xb2\xb3\xb9\xbc-\xbe])+|{SPACE}*[\\n0-9]|{SPACE}+",
    f"{SPACE}*[^{SPACE}]+|{SPACE}+",
)
MEMO_WORDS = 400_000      # of a worker; about 60 MB
LONG_WORD = 256           # characters; not remembered
# ---------------------------------------------------------------------------------------------------


class PieceCounter:
    """Counts the tokens that a piece vocabulary with byte fallback gives a text.

    Offline, at load: a cutting rule is proven when it leaves every piece of the vocabulary whole. Its cuts depend on
    two neighbouring characters alone, so no merge can ever reach across a cut, and pre-tokens can be merged one by one
    without changing the result. The pieces that merge back to themselves are the whole tokens."""

    def __init__(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        plain = [i for i in range(sp.get_piece_size()) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))]
        # The best score has the least rank; equal scores share one.
        scores = {x: r for r, x in enumerate(sorted({sp.get_score(i) for i in plain}, reverse=True))}
        self.ids = {sp.id_to_piece(i): i for i in plain}
        self.merges = Merges(
            (self.ids[p[:k]], self.ids[p[k:]], scores[sp.get_score(i)], i)
            for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids
        )
        self.cut = next((r for r in map(re.compile, CUTS) if all(r.findall(p) == [p] for p in self.ids if len(p) > 1)), re.compile(r"(?s).+"))
        self.whole = [p for p in self.ids if self.merged(p) == 1]
        self.memo = self.start = Memo(self.merged, MEMO_WORDS, LONG_WORD)

    def merged(self, word: str) -> int:
        """Tokens of one pre-token by merging; a character without a piece counts its UTF-8 bytes."""
        get = self.ids.get
        parts = [get(c, -1) for c in word]
        plain = parts if -1 not in parts else [p for p in parts if p >= 0]
        unknown = 0 if plain is parts else sum(len(c.encode()) for c, p in zip(word, parts) if p < 0)
        return unknown + sum(1 for p in self.merges.merge(parts) if p >= 0)

    def count(self, text: str) -> int:
        """Tokens of a whole text: proven whole tokens are looked up, of the rest each different one is merged."""
        if not text:
            return 0
        memo = self.memo = self.memo.renewed()
        if not memo:
            memo.update(dict.fromkeys(self.whole, 1))
        return sum(map(memo.__getitem__, self.cut.findall(SPACE + text.replace(" ", SPACE))))


@functools.lru_cache(2)
def _counter(model: bytes) -> PieceCounter:
    return PieceCounter(model)


def count_tokens(analyses: DataFrame, model_path: str, id: str = "id", text: str = "text_content", limit: int = 4096) -> DataFrame:
    """Prices text analyses before they are sent to a service that meters tokens.

    ``analyses``: ``id`` and ``text_content``; other columns are not read. ``model_path``: a piece vocabulary with byte
    fallback and no normalisation beyond spaces, on the driver. Returns one row per row: ``id, n_bytes`` (UTF-8),
    ``n_tokens`` without begin and end tokens, ``over_limit`` (more than ``limit`` tokens).

    A null or empty text has 0 bytes and 0 tokens; special strings inside a text are ordinary text; rows that repeat
    are counted each; texts are counted whole, with memory for one text and a memo of bounded size. No shuffle."""
    model = file_bytes(analyses.sparkSession, model_path)

    def step(batch):
        counter = _counter(model.value)
        tokens = [counter.count(t) if t else 0 for t in map(pa.StringScalar.as_py, batch.column(1))]
        yield pa.record_batch([batch.column(0), batch.column(2), pa.array(tokens, pa.int64())], ["id", "n_bytes", "n_tokens"])

    rows = analyses.select(F.col(id).alias("id"), F.col(text).alias("text_content"), F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint").alias("n_bytes"))
    out = on_bytes(rows, step, f"id {rows.schema['id'].dataType.simpleString()}, n_bytes bigint, n_tokens bigint")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
