"""Parameters, record specifications and the fixed connection-record schema."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Bounds:
    """min, max, sample stddev and bucket count of one continuous column, and the
    number of rows they were taken over."""

    minimum: float | None
    maximum: float | None
    stddev: float | None
    n_buckets: int
    n_rows: int | None = None


@dataclass(frozen=True)
class FieldToken:
    """How one record column becomes one token.

    kind:
      ``raw``    value text only (categorical fields and the answer)
      ``text``   value text + suffix (``181src_bytes``); doubles print like Python
      ``bucket`` bucket index + suffix (``3duration_bucketized``)
    """

    column: str
    kind: str = "text"
    suffix: str | None = None

    @property
    def token_suffix(self) -> str:
        if self.suffix is not None:
            return self.suffix
        if self.kind == "raw":
            return ""
        if self.kind == "bucket":
            return f"{self.column}_bucketized"
        return self.column


@dataclass(frozen=True)
class RecordSpec:
    """Token layout of a record: feature tokens in order, then the answer token."""

    features: tuple[FieldToken, ...]
    answer: str | None = None
    extra_bounds: tuple[str, ...] = ()

    @property
    def bucket_columns(self) -> tuple[str, ...]:
        cols = [f.column for f in self.features if f.kind == "bucket"]
        for c in self.extra_bounds:
            if c not in cols:
                cols.append(c)
        return tuple(cols)

    @property
    def n_features(self) -> int:
        return len(self.features)

    @property
    def n_tokens(self) -> int:
        return len(self.features) + (1 if self.answer else 0)


@dataclass(frozen=True)
class Params:
    """All knobs in one place. ``Params.parity()`` gives the reference's defaults."""

    # bucketing: 'stddev' = bins of one stddev from the minimum; 'unit' = splits 0,1,..,n-1
    bucket_width: str = "stddev"
    # bucket token text: 'int' -> '3', 'double' -> '3.0' (Bucketizer output printed)
    bucket_text: str = "int"
    # NaN in a bucketized column: 'error' (Bucketizer default), 'keep' (extra bucket) or
    # 'skip' (rows with NaN or NULL there are dropped, as Bucketizer does)
    on_nan: str = "error"
    # id layout
    pad_id: int = 0
    unk_id: int = 1
    first_id: int = 2
    unknown_token: str = "unknown"
    include_label_tokens: bool = True   # answer tokens get vocabulary ids too (as the reference)
    # sequence
    window: int = 40
    rows_per_chunk: int = 50001
    batch_size: int = 128
    train_chunks: int = 96
    validation_chunks: int = 4
    normal_values: tuple[str, ...] = ("normal.",)
    attack_values: tuple[str, ...] | None = None  # when set: these answers are 1, all else 0
    # masking
    mask_seed: int = 42
    maskable: int | None = None  # None: every feature position
    # learning
    class_weight: tuple[tuple[int, float], ...] = ((0, 10.0), (1, 0.2))
    loss_weight: tuple[float, ...] = (0.7, 0.3)
    n_thresholds: int = 11
    epsilon: float = 1e-7
    # physical knobs
    broadcast_max_bytes: int = 64 << 20
    rows_per_range: int = 500_000        # rows per range in global_position
    max_ranges: int = 10_000             # above that many ranges they grow instead
    salt_rows: int = 2_000_000           # rows of one key above which it is salted
    wide_tokens: int = 64                # more positions than this: explode + one join
    halo_chunk_rows: int = 20_000        # rows per chunk in sequence windows

    @classmethod
    def parity(cls, **overrides) -> "Params":
        """The reference's numbers: unit buckets printed as doubles, pad 4044,
        unknown 404404, ids from 0, 39 maskable positions."""
        base = cls(
            bucket_width="unit",
            bucket_text="double",
            pad_id=4044,
            unk_id=404404,
            first_id=0,
            maskable=39,
        )
        return replace(base, **overrides)

    def with_(self, **kw) -> "Params":
        return replace(self, **kw)

    def thresholds(self) -> list[float]:
        """Evenly spaced thresholds 0..1 as ``i * step``, the last exactly 1.0."""
        n = self.n_thresholds
        if n < 2:
            return [1.0]
        step = 1.0 / (n - 1)
        return [i * step for i in range(n - 1)] + [1.0]


# --- fixed values: the connection-record schema (42 string fields, in file order) ---
KDD_COLUMNS: tuple[str, ...] = (
    "duration", "protocol_type", "service", "flag", "src_bytes", "dst_bytes", "land",
    "wrong_fragment", "urgent", "hot", "num_failed_logins", "logged_in",
    "num_compromised", "root_shell", "su_attempted", "num_root", "num_file_creations",
    "num_shells", "num_access_files", "num_outbound_cmds", "is_host_login",
    "is_guest_login", "count", "srv_count", "serror_rate", "srv_serror_rate",
    "rerror_rate", "srv_rerror_rate", "same_srv_rate", "diff_srv_rate",
    "srv_diff_host_rate", "dst_host_count", "dst_host_srv_count",
    "dst_host_same_srv_rate", "dst_host_diff_srv_rate", "dst_host_same_src_port_rate",
    "dst_host_srv_diff_host_rate", "dst_host_serror_rate", "dst_host_srv_serror_rate",
    "dst_host_rerror_rate", "dst_host_srv_rerror_rate", "answer",
)

# --- fixed values: columns cast to double and bucketized ---
KDD_BUCKETIZED: tuple[str, ...] = (
    "duration", "dst_bytes", "count", "serror_rate", "rerror_rate", "same_srv_rate",
    "diff_srv_rate", "srv_count", "srv_serror_rate", "srv_rerror_rate",
)

# --- fixed values: token order after the three categorical tokens
# (protocol_type, flag, service); '_bucketized' names use the bucket column ---
KDD_TOKEN_FIELDS: tuple[str, ...] = (
    "duration_bucketized", "src_bytes", "dst_bytes", "land", "wrong_fragment", "urgent",
    "hot", "num_failed_logins", "logged_in", "num_compromised", "root_shell",
    "su_attempted", "num_root", "num_file_creations", "num_shells", "num_access_files",
    "num_outbound_cmds", "is_host_login", "is_guest_login", "count_bucketized",
    "srv_count_bucketized", "serror_rate_bucketized", "srv_serror_rate_bucketized",
    "rerror_rate_bucketized", "srv_rerror_rate_bucketized", "same_srv_rate_bucketized",
    "diff_srv_rate_bucketized", "srv_diff_host_rate", "dst_host_count",
    "dst_host_srv_count", "dst_host_same_srv_rate", "dst_host_diff_srv_rate",
    "dst_host_same_src_port_rate", "dst_host_srv_diff_host_rate", "dst_host_serror_rate",
    "dst_host_srv_serror_rate", "dst_host_rerror_rate", "dst_host_srv_rerror_rate",
)

KDD_CATEGORICAL: tuple[str, ...] = ("protocol_type", "flag", "service")


def kdd_spec() -> RecordSpec:
    """Connection-record layout: 3 categorical tokens, 38 field tokens, the answer.

    ``dst_bytes`` is bucketized but its raw double is the token (as the reference does);
    the other bucketized columns contribute their bucket.
    """
    feats: list[FieldToken] = [FieldToken(c, "raw") for c in KDD_CATEGORICAL]
    for name in KDD_TOKEN_FIELDS:
        if name.endswith("_bucketized"):
            feats.append(FieldToken(name[: -len("_bucketized")], "bucket"))
        elif name in KDD_BUCKETIZED:
            feats.append(FieldToken(name, "text"))  # cast to double: prints '5450.0'
        else:
            feats.append(FieldToken(name, "text"))
    return RecordSpec(features=tuple(feats), answer="answer", extra_bounds=("dst_bytes",))


def events_spec() -> RecordSpec:
    """Layout used for the ``events`` table standing in for the record stream.

    value bucket, raw value, props text and user id are the features;
    ``event_type`` is the answer (``error`` is the attack class).
    """
    return RecordSpec(
        features=(
            FieldToken("value", "bucket"),
            FieldToken("value", "text"),
            FieldToken("props", "text"),
            FieldToken("user_id", "text"),
        ),
        answer="event_type",
    )


# events: 'error' is the attack class, every other event type is normal
EVENTS_ATTACK: tuple[str, ...] = ("error",)


# stand-in values of the 42 fields from lineitem, orders and customer: SQL that Spark and
# DuckDB read alike. All are text; the columns that become buckets hold numbers.
def _wide_fields() -> tuple[str, ...]:
    whole = lambda x: f"CAST(CAST({x} AS BIGINT) AS STRING)"
    given = {
        "duration": whole("l_quantity"), "protocol_type": "l_returnflag", "service": "c_mktsegment",
        "flag": "o_orderpriority", "src_bytes": whole("floor(l_extendedprice)"),
        "dst_bytes": whole("floor(o_totalprice)"), "land": "'0'", "count": whole("l_linenumber"),
        "srv_count": whole("c_nationkey"), "serror_rate": whole("round(l_discount * 100)"),
        "srv_serror_rate": whole("round(l_tax * 100)"), "rerror_rate": whole("l_partkey % 11"),
        "srv_rerror_rate": whole("l_suppkey % 7"), "same_srv_rate": whole("o_custkey % 13"),
        "diff_srv_rate": whole("floor(c_acctbal)"), "answer": "o_orderstatus",
    }
    keys = ("l_orderkey", "l_partkey", "l_suppkey", "o_custkey", "l_linenumber")
    return tuple(given.get(c) or whole(f"({keys[i % len(keys)]} + {i}) % {3 + i}")
                 for i, c in enumerate(KDD_COLUMNS))


WIDE_FIELDS: tuple[str, ...] = _wide_fields()
