"""seqtok: connection/event records as token sentences, on Spark.

Records are read with a fixed schema, continuous fields are bucketized, every field
becomes a token, tokens get a vocabulary with frequencies, records are indexed
(unknown and masked tokens included), history windows are slid over the record
sequence, labelled, chunked and batched, token vectors are joined in and pooled with
attention weights, a class-weighted classifier is fitted and applied, and models are
compared by precision, recall, F1 and loss.

Every operator is a ``DataFrame -> DataFrame`` function built from Spark SQL
expressions or Spark ML stages; no Python UDF runs on the data path.
"""

from seqtok.config import Bounds, FieldToken, Params, RecordSpec

__all__ = ["Bounds", "FieldToken", "Params", "RecordSpec"]
