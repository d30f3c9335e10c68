"""Token counts of whole texts by a compiled tokenizer."""

from collections.abc import Iterator

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattsift.llm.frames import plus, without
from wattsift.llm.token_machine import TokenMachine, token_counts
from wattsift.llm.words import slices

COUNTS = "n_tokens bigint"
#: Shows whether a model changes texts beyond a blank in front and the sign for blanks: case, width, runs of blanks.
PROBE, PROBED = "Ａﬁ  x é ", "▁Ａﬁ▁▁x é▁"


def vocabulary(model_path: str) -> dict:
    """Ordinary pieces and their scores, from the model file of a byte-pair tokenizer with byte fallback."""
    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    ids = range(model.get_piece_size())
    if model.normalize(PROBE) != PROBED or sum(map(model.is_byte, ids)) != 256:
        raise ValueError("the machine needs a vocabulary with byte fallback and without normalisation")
    plain = [k for k in ids if not (model.is_byte(k) or model.is_unknown(k) or model.is_control(k))]
    return {"pieces": [model.id_to_piece(k) for k in plain], "scores": [model.get_score(k) for k in plain]}


def count_tokens(docs: DataFrame, model_path: str, text: str = "text", limit: int = 4096) -> DataFrame:
    """Add n_bytes (UTF-8), n_tokens and over_limit (more than ``limit`` tokens) to each row, for its whole text.

    The vocabulary (its size does not depend on the data) goes to the executors as plain lists. Each Python worker
    compiles the machine as texts ask for it and keeps it for later tasks; its memory is bounded, as states are dropped
    and made again beyond ``MOST_STATES``. One pass, no shuffle.

    NULL and empty texts have no tokens. Special strings in a text are text. Repeated rows are counted each. Columns of
    these names are replaced.
    """
    base = without(docs, "n_bytes", "n_tokens", "over_limit")
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary(model_path))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value  # one object per Python worker, which may serve many tasks
        if "machine" not in known:
            known["machine"] = TokenMachine(known["pieces"], known["scores"])
        for batch in batches:
            for part in slices(batch, text):
                counts = token_counts(known["machine"], part.column(text).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(counts, pa.int64())], names=[*part.schema.names, "n_tokens"])

    n_bytes = F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint")
    out = base.mapInArrow(count, plus(base, COUNTS))
    return out.withColumn("n_bytes", n_bytes).withColumn("over_limit", F.col("n_tokens") > limit)
