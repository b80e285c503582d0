"""Language identification (operator 2) by compression.

Each language learned has a zstandard raw-content dictionary made of sampled texts. A text is
encoded with every dictionary, and the language with the fewest bytes wins. When the runner-up is
nearly as good, or the text has no letter, the text is rejected.

Sizes are compared only between dictionaries of one length, since a longer one saves more in any
language. Languages form rungs of similar length, and each rung competes, cut to its shortest, with
all longer ones cut to the same length. So a language with little text shortens no other.
"""

from __future__ import annotations

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.llm.workers import map_batches, slices

DICTIONARY_BYTES = 65_536
PIECE_CHARS = 256
#: Pieces per language asked for. More than fit, since equal pieces count once.
SAMPLED_PIECES = 600
#: Characters encoded at a time: few enough for the dictionary to matter in every block.
BLOCK_CHARS = 2_048
#: Ends every block. Compresses to almost nothing, and keeps tiny blocks from being stored as they
#: are, which would make all languages equal.
BLOCK_END = b"\n" * 64
MIN_MARGIN = 0.01
UNKNOWN = "und"
#: Matches from three bytes on, since the short endings tell languages apart.
ENCODING = {
    "min_match": 3,
    "strategy": zstandard.STRATEGY_BTOPT,
    "search_log": 4,
    "hash_log": 16,
    "chain_log": 16,
    "window_log": 17,
    "write_content_size": False,
    "write_checksum": False,
    "write_dict_id": False,
}

SCHEMA = "doc_id bigint, held_out boolean, lang_pred string, score double, rejected boolean"


def remainder(doc_id) -> F.Column:
    """crc32 of the id as text modulo 4; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4


def learn_dictionaries(
    labelled: DataFrame, *, pieces: int = SAMPLED_PIECES, dictionary_bytes: int = DICTIONARY_BYTES
) -> dict[str, bytes]:
    """language -> dictionary content, from the rows of ``labelled`` (text, lang).

    The sample is bounded: about ``pieces`` pieces of at most ``PIECE_CHARS`` characters for each
    language, from texts whose hash is small; which ones depends on the texts alone. Copies of a text
    count once, so a language with few texts, however often they are repeated, gives a piece of each.
    Rows without text or language teach nothing. An empty table teaches no language.
    """
    rows = labelled.select("text", "lang").where("text <> '' AND lang IS NOT NULL")
    texts = F.approx_count_distinct("text").alias("n")
    totals = {r["lang"]: max(r["n"], 1) for r in rows.groupBy("lang").agg(texts).collect()}
    if not totals:
        return {}
    place = F.xxhash64("text")
    share = F.create_map(
        *[F.lit(x) for lang, n in totals.items() for x in (lang, min(1.0, pieces / n))]
    )[F.col("lang")]
    spare = F.greatest(F.length("text") - PIECE_CHARS, F.lit(0)) + 1
    start = F.pmod(F.xxhash64("text", F.lit("start")), spare).cast("int") + 1
    sample = (
        rows.where(F.pmod(place, F.lit(1 << 30)) < share * (1 << 30))
        .select("lang", place.alias("place"), F.substr("text", start, F.lit(PIECE_CHARS)).alias("piece"))
        .groupBy("lang", "place")
        .agg(F.min("piece").alias("piece"))
    )
    found: dict[str, list[bytes]] = {lang: [] for lang in totals}
    for row in sorted(sample.collect(), key=lambda r: (r["lang"], r["place"], r["piece"])):
        found[row["lang"]].append(row["piece"].lower().encode())
    joined = {lang: b"\n".join(parts) for lang, parts in found.items()}
    return {lang: content[:dictionary_bytes] for lang, content in sorted(joined.items()) if content}


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def rungs(dictionaries: dict[str, bytes]) -> list[tuple[int, list[str]]]:
    """(bytes, languages), longest first. The longest dictionary of a rung is at most twice as long
    as its shortest, and ``bytes`` is the length of the shortest."""
    found: list[tuple[int, list[str]]] = []
    top = 0
    for lang in sorted(dictionaries, key=lambda lang: (-len(dictionaries[lang]), lang)):
        size = len(dictionaries[lang])
        if found and 2 * size >= top:
            found[-1] = (size, [*found[-1][1], lang])
        else:
            found.append((size, [lang]))
            top = size
    return found


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    encoding = zstandard.ZstdCompressionParameters(**ENCODING)
    known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    known.precompute_compress(compression_params=encoding)
    return zstandard.ZstdCompressor(compression_params=encoding, dict_data=known)


def _backwards(content: bytes) -> bytes:
    """As many letters of the same kinds, in no language: what a single longest dictionary meets."""
    return content.decode(errors="ignore")[::-1].encode()


class Classifier:
    """Compressors of all languages, set up once for a task."""

    def __init__(self, dictionaries: dict[str, bytes], min_margin: float):
        self.min_margin = min_margin
        #: For each rung: the languages that belong to it, and (language, compressor) of all that meet.
        self.rungs = []
        longer: list[str] = []
        for size, own in rungs(dictionaries):
            longer += own
            meet = [(lang, _compressor(dictionaries[lang][:size])) for lang in sorted(longer)]
            if len(meet) == 1 and len(dictionaries) > 1:
                meet.append((None, _compressor(_backwards(dictionaries[own[0]][:size]))))
            self.rungs.append((set(own), meet))

    def judge(self, text: str | None) -> tuple[str, float, bool]:
        """(language, margin, rejected)."""
        if not text or not self.rungs or not has_letter(text):
            return UNKNOWN, 0.0, True
        text = text.lower()
        blocks = [
            text[at : at + BLOCK_CHARS].encode() + BLOCK_END
            for at in range(0, len(text), BLOCK_CHARS)
        ]
        judged = []  # bytes of a language against the best other one at its length, and its name
        for own, meet in self.rungs:
            sizes = [
                (sum(len(compressor.compress(block)) for block in blocks), lang)
                for lang, compressor in meet
            ]
            if len(sizes) == 1:
                return sizes[0][1], 1.0, 1.0 < self.min_margin
            least, second = sorted(size for size, _ in sizes)[:2]
            judged += [
                (size / (second if size == least else least), lang) for size, lang in sizes if lang in own
            ]
        best, lang = min(judged)
        margin = max(0.0, 1.0 - best)
        return lang, margin, margin < self.min_margin


def identify(
    docs: DataFrame,
    dictionaries: dict[str, bytes],
    *,
    min_margin: float = MIN_MARGIN,
) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every row of ``docs`` (doc_id, text).

    ``score`` is the share of bytes the best language saves against the runner-up, 0 to 1, with
    dictionaries of one length. A null
    or empty text, one without a letter, and every text when no language was learned are ``und``
    with score 0, and rejected; so is a text with a margin below ``min_margin``, which keeps its
    best guess. Equal sizes go to the name that sorts first. Whole texts are read, in blocks.
    Repeated rows give repeated rows; other columns are not read. Narrow: no shuffle.
    """

    def run(batches):
        classifier = Classifier(dictionaries, min_margin)
        for part in slices(batches):
            judged = [classifier.judge(text) for text in part.column("text").to_pylist()]
            langs, scores, rejected = zip(*judged) if judged else ([], [], [])
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    part.column("held_out"),
                    pa.array(langs, pa.string()),
                    pa.array(scores, pa.float64()),
                    pa.array(rejected, pa.bool_()),
                ],
                ["doc_id", "held_out", "lang_pred", "score", "rejected"],
            )

    narrow = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (remainder(F.col("doc_id")) == 2).alias("held_out"),
        "text",
    )
    return map_batches(narrow, run, SCHEMA)


def keep_identified(
    docs: DataFrame,
    dictionaries: dict[str, bytes],
    *,
    min_margin: float = MIN_MARGIN,
) -> DataFrame:
    """The rows of ``docs`` that ``identify`` does not reject, with all their columns as they are."""

    def run(batches):
        classifier = Classifier(dictionaries, min_margin)
        for part in slices(batches):
            kept = [not classifier.judge(text)[2] for text in part.column("text").to_pylist()]
            yield part.filter(pa.array(kept, pa.bool_()))

    return map_batches(docs, run, docs.schema)


def training_rows(docs: DataFrame) -> DataFrame:
    """The rows to learn from: those that are not held out."""
    return docs.where(remainder(F.col("doc_id")) != 2)
