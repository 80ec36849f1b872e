"""Quality rules by tokeniser fertility: how well public vocabularies, which nobody trained on this corpus, fit a text.

Three measures of every whole text: characters per token of a byte-level vocabulary, the share of tokens that a vocabulary
of pieces has to spell as single bytes, and the entropy of those pieces against the most that so many tokens can have. Text
of a language keeps to narrow bands of all three; glued, scrambled, machine-made or wrongly labelled text leaves them.

The bands of a language and script come from the quartiles of all its distinct texts (copies count once), widened by a
fixed share and, for short texts, by what chance moves. Tokens are those of the text's words, each after one space, so a
batch encodes each distinct word once.
"""

from __future__ import annotations

import base64
import bisect
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import staged

WORD = re.compile("[^\x20\x09-\x0d]+")
SYMBOLS = "#*$%&|<>"
#: Base rules: fewest words, most percent of words in repeated windows.
FEWEST_WORDS, MOST_REPEATED = 50, 50
#: Bands: steps of a measure, distinct texts that make a band, quartile ranges on each side, least half widths, by chance.
STEPS, BAND_TEXTS, REACH = 512, 20, 6.0
LEAST_WIDTH = {"chars_per_token": 0.12, "byte_share": 0.15, "evenness": 0.2}  # of the median, of all tokens, absolute
CHANCE = 1.5
MEASURES = tuple(LEAST_WIDTH)
#: Scripts told apart by their first code points (fixed values of the Unicode block chart); all else is ``other``.
SCRIPTS = (
    (0x41, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"), (0x590, "hebrew"), (0x600, "arabic"), (0x900, "indic"),
    (0xE00, "thai"), (0xE80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x1380, "other"), (0x1E00, "latin"),
    (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"),
    (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"), (0x30000, "other"),
)
_STARTS, _NAMES = [a for a, _ in SCRIPTS], [b for _, b in SCRIPTS]
BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
MEASURED = f"doc_id long, lang string, {BASE}, script string, tokens long, text_key long, chars_per_token double, byte_share double, evenness double"


def script_of(word: str) -> str:
    """Of the word's first letter; words without one have none."""
    for c in word:
        if unicodedata.category(c)[0] == "L":
            return _NAMES[max(0, bisect.bisect_right(_STARTS, ord(c)) - 1)]
    return ""


@lru_cache(maxsize=2)
def _vocabularies(byte_level: str, by_pieces: str):
    import sentencepiece
    import tiktoken
    from public_tokenizers import PATTERN

    with open(byte_level, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    pieces = sentencepiece.SentencePieceProcessor(model_file=by_pieces)
    is_byte = np.array([pieces.is_byte(i) for i in range(pieces.get_piece_size())])
    return tiktoken.Encoding("fertility", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), pieces, is_byte


def repeated_words(codes: np.ndarray, span: int = 3) -> int:
    """How many words stand in a window of ``span`` words that the text has twice or more."""
    n = len(codes) - span + 1
    if n < 2:
        return 0
    key = codes[:n]
    for k in range(1, span):
        _, key = np.unique(key * (codes.max() + 1) + codes[k : k + n], return_inverse=True)
    again = np.bincount(key)[key] > 1
    covered = np.zeros(len(codes), bool)
    for k in range(span):
        covered[k : k + n] |= again
    return int(covered.sum())


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(lines) - len(set(lines))


def measure(texts: list[str], byte_level: str, by_pieces: str) -> list[tuple]:
    """The base counts and the three measures of each text; texts without words have measures of zero."""
    quick, pieces, is_byte = _vocabularies(byte_level, by_pieces)
    index: dict[str, int] = {}
    coded = []
    for text in texts:
        coded.append(np.fromiter((index.setdefault(w, len(index)) for w in WORD.findall(text)), np.int64))
    words = list(index)
    safe = [w.encode("utf-8", "replace").decode() for w in words]
    length = np.fromiter(map(len, words), np.int64, len(words))
    own = [quick.encode_ordinary(" " + w) for w in safe]
    tokens = np.fromiter(map(len, own), np.int64, len(words))
    ids = pieces.encode(safe, num_threads=1) if safe else []
    sizes = np.fromiter(map(len, ids), np.int64, len(words))
    ends = np.cumsum(sizes)
    flat = np.fromiter((i for x in ids for i in x), np.int64, int(sizes.sum()))
    in_bytes = np.add.reduceat(is_byte[flat].astype(np.int64), ends - sizes) if len(flat) else sizes
    scripts = [script_of(w) for w in words]
    names = sorted(set(scripts) - {""})
    script = np.array([names.index(s) if s else len(names) for s in scripts], np.int64)
    out = []
    for text, code in zip(texts, coded, strict=True):
        n = len(code)
        base = (n, int(length[code].sum()), sum(map(text.count, SYMBOLS)), repeated_lines(text), repeated_words(code))
        if not n:
            out.append((*base, "none", 0, 0, 0.0, 0.0, 0.0))
            continue
        seen, times = np.unique(code, return_counts=True)
        by_script = np.bincount(script[seen], length[seen] * times, len(names) + 1)[: len(names)]
        own_script = names[int(by_script.argmax())] if by_script.any() else "none"
        # The pieces of the distinct words, each as often as its word stands.
        many = sizes[seen]
        place = np.repeat(ends[seen] - many, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        _, which = np.unique(flat[place], return_inverse=True)
        count = np.bincount(which, np.repeat(times, many))
        total = float(count.sum())
        entropy = float(-(count / total * np.log2(count / total)).sum())
        key = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)
        shown = int((tokens[seen] * times).sum())
        out.append((*base, own_script, shown, key, base[1] / max(1, shown), float((in_bytes[seen] * times).sum()) / total, entropy / max(1.0, float(np.log2(total)))))
    return out


def measures(docs: DataFrame, byte_level: str, by_pieces: str, text_col: str = "text", id_col: str = "doc_id", lang_col: str = "lang") -> DataFrame:
    """MEASURED for each row, in whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 5 + [pa.string(), pa.int64(), pa.int64()] + [pa.float64()] * 3
        for batch in batches:
            if batch.num_rows:
                columns = zip(*measure([t or "" for t in batch.column(2).to_pylist()], byte_level, by_pieces), strict=True)
                arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], names=[c.split()[0] for c in MEASURED.split(", ")])

    return docs.select(F.col(id_col).cast("long"), F.coalesce(F.col(lang_col), F.lit("und")), text_col).mapInArrow(run, MEASURED)


def base_failed() -> Column:
    return (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def bands(measured: DataFrame, least: int = BAND_TEXTS) -> DataFrame:
    """lang, script and the quartiles (low, mid, high) of each measure over the distinct texts that pass the base rules."""
    steps = [F.round(F.col(m) * STEPS).cast("long").alias(m) for m in MEASURES]
    once = measured.filter(~base_failed()).select("lang", "script", "text_key", *steps).distinct()
    counted = once.groupBy("lang", "script").agg(F.count("*").alias("texts"), *[F.percentile(m, [0.25, 0.5, 0.75]).alias(m) for m in MEASURES])
    ends = [(F.col(m)[i] / STEPS).alias(f"{m}_{e}") for m in MEASURES for i, e in enumerate(("low", "mid", "high"))]
    return counted.filter(F.col("texts") >= least).select("lang", "script", *ends)


def leaves_band() -> Column:
    """Whether a row with its bands breaks one. A row without bands breaks none."""
    out = F.lit(False)
    for m, least in LEAST_WIDTH.items():
        low, mid, high = (F.col(f"{m}_{e}") for e in ("low", "mid", "high"))
        scale = mid if m == "chars_per_token" else F.lit(1.0)
        room = F.greatest((high - low) * REACH, scale * least) + scale * CHANCE / F.sqrt(F.greatest(F.col("tokens"), F.lit(1)))
        above = F.col(m) > high + room
        out = out | (above if m == "byte_share" else above | (F.col(m) < low - room))
    return F.coalesce(out, F.lit(False))


def fertility_rules(docs: DataFrame, byte_level: str, by_pieces: str, least: int = BAND_TEXTS) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, and the measures of every row.

    Null and empty texts have no words and fail the base rules; texts without letters have the script ``none``. A null
    language is ``und``. A language and script with fewer than ``least`` distinct texts has no bands, and its texts are
    judged by the base rules alone. Repeated rows fare alike, and copies don't move the bands. Null ids stay.
    """
    rows = staged(measures(docs, byte_level, by_pieces), "fertility")
    judged = rows.join(bands(rows, least), ["lang", "script"], "left")
    base = [c.split()[0] for c in BASE.split(", ")]
    return judged.select("doc_id", *base, base_failed().alias("base_failed"), (~base_failed() & ~leaves_band()).alias("kept"), "script", "tokens", *MEASURES)
