"""Record layouts, blame texts and the detection thresholds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# The three blame texts stored in ban records.
REQUEST_BLAME = "request count bucket overflow"
BYTE_BLAME = "byte count bucket overflow"
RATIO_BLAME = "file ratio bucket overflow"

# Fixed value: the file-ratio level counts hundred-thousandths of a file.
RATIO_UNIT = 100_000

LOG_RECORD = T.StructType(
    [
        T.StructField("time", T.StringType()),
        T.StructField("client", T.StringType()),
        T.StructField("server", T.StringType()),
        T.StructField("method", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("status", T.IntegerType()),
        T.StructField("sent", T.LongType()),
        T.StructField("duration", T.StringType()),
        T.StructField("host", T.StringType()),
        T.StructField("agent", T.StringType()),
    ]
)

REQUEST_COLUMNS = [
    "seq",
    "time",
    "client",
    "client_key",
    "family",
    "server",
    "method",
    "url",
    "status",
    "sent",
    "duration_us",
    "host",
    "agent",
]

INVENTORY = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("is_dir", T.BooleanType()),
        T.StructField("scanned_at", T.TimestampType()),
    ]
)

BAN_RECORD = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("prefix", T.StringType()),
        T.StructField("blame", T.StringType()),
        T.StructField("expires_at", T.TimestampType()),
    ]
)

MANUAL_BAN = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("prefix", T.StringType()),
        T.StructField("blame", T.StringType()),
        T.StructField("expires_at", T.StringType()),
    ]
)


@dataclass(frozen=True)
class Measure:
    """One leaky bucket: ``cost`` names the column added per event."""

    name: str
    cost: str
    leak: int
    volume: int
    ban_s: int
    blame: str


@dataclass(frozen=True)
class Thresholds:
    """Detection settings; the defaults are the documented ones.

    ``floor``        keep levels at or above zero (textbook bucket)
    ``unmap_v4``     treat ``::ffff:a.b.c.d`` as IPv4 when building the prefix
    ``idle_reset_s`` a longer gap starts a fresh bucket; ``None`` never does
    ``prefilter``    keep keys that can never overflow away from Python
    """

    request_leak: int = 10
    request_volume: int = 50
    request_ban_s: int = 24 * 3600
    byte_leak: int = 40_000_000
    byte_volume: int = 20_000_000_000
    byte_ban_s: int = 24 * 3600
    ratio_leak: int = 5
    ratio_volume: int = 500_000
    ratio_ban_s: int = 7 * 24 * 3600
    v4_prefix: int = 24
    v6_prefix: int = 48
    size_ttl_s: int = 6 * 3600
    prune_interval_s: int = 3600
    dst_ports: tuple[int, ...] = (80, 443)
    floor: bool = False
    unmap_v4: bool = False
    idle_reset_s: int | None = None
    prefilter: bool = True

    def __post_init__(self) -> None:
        if not 0 <= self.v4_prefix <= 32:
            raise ValueError(f"v4_prefix out of range: {self.v4_prefix}")
        if not 0 <= self.v6_prefix <= 128:
            raise ValueError(f"v6_prefix out of range: {self.v6_prefix}")
        for name in ("request_leak", "byte_leak", "ratio_leak", "size_ttl_s"):
            if getattr(self, name) < 0:
                raise ValueError(f"{name} must not be negative")
        if self.idle_reset_s is not None and self.idle_reset_s <= 0:
            raise ValueError("idle_reset_s must be positive")
        if any(not 0 <= p <= 65535 for p in self.dst_ports):
            raise ValueError("dst_ports must be 16-bit port numbers")
        # Pruning more often than once a minute is never useful.
        object.__setattr__(self, "prune_interval_s", max(60, self.prune_interval_s))

    @property
    def client_measures(self) -> list[Measure]:
        """Request rate first: it wins when both overflow on one event."""
        return [
            Measure("request", "one", self.request_leak, self.request_volume,
                    self.request_ban_s, REQUEST_BLAME),
            Measure("byte", "sent", self.byte_leak, self.byte_volume,
                    self.byte_ban_s, BYTE_BLAME),
        ]

    @property
    def path_measures(self) -> list[Measure]:
        return [
            Measure("ratio", "ratio_cost", self.ratio_leak, self.ratio_volume,
                    self.ratio_ban_s, RATIO_BLAME)
        ]
