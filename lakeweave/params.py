"""Default parameters of discovery, profiling and matching.

Fixed values: they decide results, so they are stated here once and nowhere else.
"""

from __future__ import annotations

from dataclasses import dataclass

# Namespace of all deterministic (UUIDv5) identifiers.
ID_NAMESPACE = "adac0000-0000-0000-0000-000000000001"

LOGICAL_TYPES = ("int", "float", "str", "date", "bool")
NUMERIC_TYPES = ("int", "float", "date")
CATEGORICAL_TYPES = ("str", "bool")

# Ordered (source, target) type pairs that count as compatible. Not symmetric.
COMPATIBLE_TYPES = (
    ("int", "float"),
    ("float", "int"),
    ("int", "str"),
    ("float", "str"),
    ("date", "str"),
    ("str", "date"),
)

TABLE_STATUSES = ("PENDING", "INGESTED", "PROFILING", "READY", "FAILED", "ARCHIVED", "REJECTED")

# Words in a user hint that decide between extending columns and appending rows.
JOIN_HINTS = ("join", "关联", "连接", "扩充属性")
UNION_HINTS = ("union", "合并", "追加", "并集")


@dataclass(frozen=True)
class DiscoveryParams:
    """Thresholds, cut-offs and ranking weights of the three-layer cascade."""

    theta_1: float = 0.20
    theta_2: float = 0.55
    theta_3: float = 0.50
    k_1: int = 120
    k_2: int = 40
    w_1: float = 0.2
    w_2: float = 0.3
    w_3: float = 0.5


JOIN_PLAN = DiscoveryParams()
UNION_PLAN = DiscoveryParams(w_1=0.4, w_2=0.4, w_3=0.2)
PLANS = {"JOIN": JOIN_PLAN, "UNION": UNION_PLAN}

# Layer 1: weights of term cosine and type-multiset overlap.
OMEGA_TEXT = 0.7
OMEGA_TYPE = 0.3
MIN_DF = 2
MAX_DF = 0.9
# Layer 2: fewer survivors than this trigger the relaxed candidate set of the same size.
MIN_SURVIVORS = 3
# Layer 3: candidates per scoring request, columns shown of the query and of a candidate.
VERDICT_BATCH = 10
QUERY_COLUMNS_SHOWN = 20
CANDIDATE_COLUMNS_SHOWN = 10
VERDICT_TTL_HOURS = 168

EMBEDDING_DIM = 384
# Hits per asking column, and tables that they are rolled up to.
TOP_COLUMNS = 5
TOP_TABLES_BY_COLUMNS = 10
ENCODE_BATCH = 256

# Profiling.
TOP_VALUES = 20
SAMPLE_VALUES = 5
SAMPLE_ROWS = 10_000
SAMPLE_SEED = 42
HEAD_ROWS = 300
VOCAB_MIN_FREQ = 5
REFIT_GROWTH = 0.5
KEY_DISTINCT_RATIO = 0.95

# Column matching.
NAME_WEIGHTS = (0.4, 0.3, 0.3)  # edit distance, common subsequence, tokens
TYPE_PARTIAL = 0.5
NUMERIC_WEIGHTS = (0.4, 0.3, 0.3)  # mean, deviation, quartiles
CATEGORY_WEIGHTS = (0.5, 0.5)  # value overlap, frequency cosine
EPSILON = 1e-8
THETA_CAND = 0.35
THETA_MATCH = 0.70
TARGETS_PER_SOURCE = 10
SMD_NULL_RATIO = 0.99
SSD_MAX_ROWS = 10
JOIN_NAME_SIMILARITY = 0.5


@dataclass(frozen=True)
class ScenarioWeights:
    text: float
    struct: float
    stat: float


SCENARIOS = {
    "SMD": ScenarioWeights(0.6, 0.4, 0.0),
    "SSD": ScenarioWeights(0.5, 0.3, 0.2),
    "SLD": ScenarioWeights(0.4, 0.2, 0.4),
}

# Task events.
EVENTS_PER_TASK = 200
TASKS_KEPT = 512
# Heartbeats in a row after which a silent task gets no more: a day of them.
MOST_HEARTBEATS = 2880
HEARTBEAT_SECONDS = 10
TERMINAL_EVENT = "task_completed"
TIMELINE_NODES = (
    "Planner",
    "Profiling",
    "Retrieval:L1",
    "Retrieval:L2",
    "Retrieval:L3",
    "Matcher:filtering",
    "Matcher:LLM",
    "Matcher:decision",
)
LAYERED_AGENTS = ("Retrieval", "Matcher")
EVENT_STATUS = {
    "agent_started": "running",
    "agent_degraded": "degraded",
    "agent_failed": "failed",
    "agent_completed": "success",
}
EVENT_METRICS = ("input_size", "output_size", "latency_ms", "llm_tokens", "reason", "message")


@dataclass(frozen=True)
class ScaleParams:
    """Sizes that bound what a single task holds. Results never depend on them."""

    block_queries: int = 4096
    block_candidates: int = 16384
    # Postings of a block of texts, and bytes of packed blocks that a task meets in turn.
    block_postings: int = 2**19
    paired_bytes: int = 2**27
    # Tokens of the texts that get numbers for their terms together.
    chunk_tokens: int = 2**20
    # Bytes of the vectors, in single precision, of cells that are searched together.
    block_bytes: int = 2**24
    # Vectors per cell on average, at most so many cells, and vectors from which centroids are learned.
    cell_vectors: int = 8192
    max_cells: int = 2048
    centroid_sample: int = 16384
    # Values of one column, or of a range of it, that one task puts in order.
    values_in_order: int = 1_000_000


SCALE = ScaleParams()
