"""Encoding and decoding with a word-end byte-pair vocabulary; words are merged by a contiguous rank array."""

from __future__ import annotations

import functools
import json
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import file_bytes, on_bytes
from sightline.llm.merging import Memo, Merges

# ---------------------------------------------------------------------------------------- Fixed values
#: The vocabulary's own splitting rule, over lower-cased text.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\t-\r \x85\xa0  -     　\p{L}\p{N}]+"
MEMO_WORDS = 300_000      # of a worker; about 80 MB
LONG_WORD = 256           # characters; not remembered
#: The library's characters are those of Unicode 16. Letters and numbers that came later, which it takes for signs:
LATER = """
558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB
11DF1 16EA0-16EB8 16EBB-16ED3 16FF2-16FF3 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24
1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479
3D000-3FC3F
"""
#: Capitals that the library lowers and Python's own table does not have yet.
CAPITALS = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
CAPITALS |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
# ---------------------------------------------------------------------------------------------------


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte: itself where it prints, else the next one from U+0100 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(prints)]
    return {b: chr(b) for b in prints} | {b: chr(0x100 + k) for k, b in enumerate(rest)}


@functools.cache
def splitters():
    """The splitting rule, a search for characters that are rare and that ``regex`` or Python takes otherwise than the
    library, and the rule for texts with such ones."""
    later = "".join("-".join(chr(int(x, 16)) for x in r.split("-")) for r in LATER.split())
    known = WORDS.replace(r"[\p{L}]+", rf"(?:(?![{later}])\p{{L}})+").replace(r"|[\p{N}]|", rf"|(?![{later}])\p{{N}}|")
    head, signs = known.rsplit("|", 1)
    rare = regex.compile(f"[{later}{''.join(map(chr, CAPITALS))}]").search
    return regex.compile(WORDS).findall, rare, regex.compile(head + rf"|(?:[{later}]|{signs[:-1]})+").findall


class WordBpe:
    """The vocabulary file read as tables: token ids, merge ranks, special strings."""

    def __init__(self, spec: bytes):
        d = json.loads(spec)
        model = d["model"]
        self.ids, self.end = model["vocab"], model["end_of_word_suffix"]
        self.merges = Merges((self.ids[a], self.ids[b], r, self.ids[a + b]) for r, (a, b) in enumerate(model["merges"]))
        self.special = {t["content"]: t["id"] for t in d["added_tokens"]}
        self.tokens = {i: t for t, i in [*self.ids.items(), *self.special.items()]}
        self.usual, self.rare, self.known = splitters()
        self.parted = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self.letters = [self.ids.get(c, -1) for _, c in sorted(byte_letters().items())]
        self.ends = [self.ids.get(c + self.end, -1) for _, c in sorted(byte_letters().items())]
        self.memo = Memo(self.word, MEMO_WORDS, LONG_WORD)

    def word(self, word: str) -> bytes:
        """One word's ids as little-endian unsigned 32-bit integers."""
        letters, b = self.letters, word.encode()
        parts = [letters[x] for x in b]
        parts[-1] = self.ends[b[-1]]
        return array("I", [p for p in self.merges.merge(parts) if p >= 0]).tobytes()

    def plain(self, text: str, out: list[bytes]) -> None:
        text = unicodedata.normalize("NFC", text)
        # Letter by letter: a capital sigma is never read as the final one.
        text = (text.replace("Σ", "σ") if "Σ" in text else text).lower()
        memo = self.memo = self.memo.renewed()
        out.extend(map(memo.__getitem__, self.known(text.translate(CAPITALS)) if self.rare(text) else self.usual(text)))

    def encode(self, text: str) -> bytes:
        """A whole text's ids, packed; special strings inside it are their special tokens."""
        out: list[bytes] = []
        if self.parted is None or not any(s in text for s in self.special):
            self.plain(text, out)
        else:
            for part in self.parted(text):
                if part in self.special:
                    out.append(np.array([self.special[part]], "<u4").tobytes())
                elif part:
                    self.plain(part, out)
        return b"".join(out)

    def decode(self, packed: bytes) -> str:
        """The tokens of packed ids with a blank between them: the vocabulary names no other decoder. Ids that it does
        not have are left out."""
        get = self.tokens.get
        return " ".join([t for i in np.frombuffer(packed, "<u4").tolist() if (t := get(i)) is not None])


@functools.lru_cache(2)
def _bpe(spec: bytes) -> WordBpe:
    return WordBpe(spec)


def encode_texts(analyses: DataFrame, vocabulary_path: str, id: str = "id", text: str = "text_content") -> DataFrame:
    """Encodes the texts of analyses for a text model.

    ``analyses``: ``id`` and ``text_content``; other columns are not read. Returns one row per row: ``id, n_tokens,
    token_ids`` (binary, little-endian unsigned 32-bit integers, the form in which training shards are written).

    A null or empty text has no tokens; special strings inside a text become their special tokens, none is added; rows
    that repeat are encoded each; texts are encoded whole. No shuffle."""
    spec = file_bytes(analyses.sparkSession, vocabulary_path)

    def step(batch):
        bpe = _bpe(spec.value)
        packed = [bpe.encode(t) if t else b"" for t in map(pa.StringScalar.as_py, batch.column(1))]
        yield pa.record_batch([batch.column(0), pa.array([len(p) // 4 for p in packed], pa.int64()), pa.array(packed, pa.binary())], ["id", "n_tokens", "token_ids"])

    rows = analyses.select(F.col(id).alias("id"), F.col(text).alias("text_content"))
    return on_bytes(rows, step, f"id {rows.schema['id'].dataType.simpleString()}, n_tokens bigint, token_ids binary")


def decode_texts(encoded: DataFrame, vocabulary_path: str, id: str = "id", token_ids: str = "token_ids") -> DataFrame:
    """The way back: ``id, token_ids, decoded_text`` of packed ids, special tokens included. Null ids are no ids, and
    no ids are an empty text."""
    spec = file_bytes(encoded.sparkSession, vocabulary_path)

    def step(batch):
        bpe = _bpe(spec.value)
        texts = [bpe.decode(p) if p else "" for p in map(pa.BinaryScalar.as_py, batch.column(1))]
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["id", "token_ids", "decoded_text"])

    rows = encoded.select(F.col(id).alias("id"), F.col(token_ids).alias("token_ids"))
    return on_bytes(rows, step, f"id {rows.schema['id'].dataType.simpleString()}, token_ids binary, decoded_text string")
