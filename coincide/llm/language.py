"""Language identification by compression.

Each language has zstandard dictionaries of raw content: lower-cased letters of sample texts. A
text is compressed with the dictionaries of every language, and the language with the smallest
frames wins. Texts under ``SHORT`` bytes are compressed with several dictionaries of each language
and the sizes added, as one frame of a short text says little. Longer texts than ``BLOCK`` bytes are
cut into equal blocks, each a frame of its own against the fresh dictionary, and the sizes added: a
frame gains from its dictionary once, so the margin of one frame would fall with the text's length.

Edge cases: a null text, or one without a letter, is ``und`` with score 0 and is not accepted. With
no training row every text is ``und``. Ties go to the language whose name sorts first, and are not
accepted. Repeated rows get equal results.
"""

from __future__ import annotations

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coincide.llm.stage import bounded_sample
from coincide.llm.text import with_columns

UNKNOWN = "und"
SHORT, BLOCK = 2000, 32_000
LETTER = regex.compile(r"\p{L}")
#: Everything in ASCII that is no letter becomes a space.
SPACES = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Per language: dictionaries, bytes of each, and most bytes that one sample text gives.
DICTIONARIES, DICTIONARY_BYTES, SAMPLE_BYTES = 3, 32_000, 3_000
PARAMS = dict(
    window_log=18, chain_log=16, hash_log=16, search_log=4, min_match=4, target_length=64,
    strategy=zstandard.STRATEGY_LAZY2, write_content_size=False, write_checksum=False, write_dict_id=False,
)
OUTPUT = "lang_pred string, score double, margin double, accepted boolean"


def letters(text: str) -> bytes:
    """Lower-cased words of letters between single spaces."""
    return b" ".join(text.lower().encode().translate(SPACES).split())


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang",
        per_label: int = 120) -> dict[str, list[bytes]]:
    """Dictionaries of each label, from at most ``per_label`` rows of it (the bound of the sample).

    What the driver collects is bounded: labels x ``per_label`` x ``SAMPLE_BYTES`` characters.
    """
    some = docs.where(F.col(text).isNotNull() & (F.length(text) > 0)).select(
        key, label, F.substring(text, 1, SAMPLE_BYTES).alias("part"))
    pool: dict[str, list[bytes]] = {}
    for row in bounded_sample(some, key, label, per_label).orderBy(label, F.xxhash64(F.col(key).cast("string")), key).collect():
        if LETTER.search(row["part"]):
            pool.setdefault(str(row[label]), []).append(letters(row["part"]))
    return {
        lang: [b" ".join(parts[k::DICTIONARIES])[:DICTIONARY_BYTES] for k in range(DICTIONARIES) if parts[k::DICTIONARIES]]
        for lang, parts in sorted(pool.items())
    }


def compressors(model: dict[str, list[bytes]]) -> dict[str, list]:
    params = zstandard.ZstdCompressionParameters(**PARAMS)
    out: dict[str, list] = {}
    for lang, contents in model.items():
        for content in contents:
            held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(compression_params=params)
            out.setdefault(lang, []).append(zstandard.ZstdCompressor(dict_data=held, compression_params=params))
    return out


def blocks(data: bytes) -> list[bytes]:
    """The data in as few equal pieces as ``BLOCK`` allows."""
    n = max(1, -(-len(data) // BLOCK))
    return [data[len(data) * k // n : len(data) * (k + 1) // n] for k in range(n)]


def judge(text: str | None, held: dict[str, list]) -> tuple[str, float, float]:
    """Language, score in 0..1 and margin (how much larger the runner-up is, as a share)."""
    if text is None or not held or not LETTER.search(text):
        return UNKNOWN, 0.0, 0.0
    data = letters(text)
    use = DICTIONARIES if len(data) < SHORT else 1
    while len(data) < 256:  # zstandard leaves very small inputs as they are
        data = data + b" " + data
    cut = blocks(data)
    sizes = sorted((sum(len(c.compress(b)) for c in made[:use] for b in cut) / min(use, len(made)), lang) for lang, made in held.items())
    best = sizes[0][0]
    share = sum(2.0 ** max(-1000.0, (best - size) / 4) for size, _ in sizes)
    margin = (sizes[1][0] - best) / best if len(sizes) > 1 else 1.0
    return sizes[0][1], 1.0 / share, margin


def predict(docs: DataFrame, model: dict[str, list[bytes]], text: str = "text", keep: list[str] | None = None,
            min_margin: float = 0.0005) -> DataFrame:
    """Add ``lang_pred``, ``score``, ``margin`` and ``accepted`` to each row, on its whole text."""

    def make():
        held = compressors(model)

        def work(chunk):
            found = [judge(t, held) for t in chunk.column(chunk.schema.get_field_index(text)).to_pylist()]
            return [
                pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()),
                pa.array([f[2] for f in found], pa.float64()),
                pa.array([f[0] != UNKNOWN and f[2] >= min_margin for f in found], pa.bool_()),
            ]

        return work

    return with_columns(docs, text, OUTPUT, make, keep)
