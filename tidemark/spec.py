"""What an operator needs to know of a stream, and the constants of the evaluation protocol."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field


@dataclass(frozen=True)
class StreamSpec:
    """Roles of the columns of a labelled event stream; ``seq`` is the dense position in time order."""

    id: str = "id"
    order: tuple[str, ...] = ("ts", "id")
    seq: str = "seq"
    label: str = "y"
    actor: str = "actor"
    hub: str = "hub"
    text: str = "message"
    effort: str = "effort"
    project: str = "project"


@dataclass(frozen=True)
class Protocol:
    """Prequential protocol: share of warm-up, block length, label delay, smoothing, iterations."""

    warmup: float = 0.05
    block: int = 200
    gap: int = 50
    smoothing: float = 5.0
    damping: float = 0.85
    iterations: int = 40
    init_each: int = 10
    roll: int = 150
    stride: int = 25
    most_blocks: int = 100

    def first_scored(self, n: int) -> int:
        return int(self.warmup * n)

    def block_length(self, n: int) -> int:
        """``block`` rows, more where the stream has more than ``most_blocks`` of them, so that work grows with the stream."""
        return max(self.block, -(-n // self.most_blocks))

    def starts(self, n: int) -> list[int]:
        """Where the scored blocks of a stream of ``n`` rows begin."""
        return list(range(self.first_scored(n), n, self.block_length(n)))

    def as_dict(self) -> dict:
        return asdict(self)


PROTOCOL = Protocol()


@dataclass(frozen=True)
class Layer:
    """A structural layer of code graphs: node label, attaching relation and property names."""

    kind: str
    label: str
    relation: str
    type_column: str = "ast_type"
    group_column: str = "node_group"


@dataclass(frozen=True)
class Layers:
    """Registry of layers; the change relations are the same for all."""

    known: dict[str, Layer] = field(
        default_factory=lambda: {
            "ast": Layer("ast", "ASTNode", "HAS_AST"),
            "cfg": Layer("cfg", "CFGNode", "HAS_CFG"),
            "dfg": Layer("dfg", "DFGNode", "HAS_DFG"),
            "pdg": Layer("pdg", "PDGNode", "HAS_PDG"),
            "seq": Layer("seq", "SEQNode", "HAS_SEQ"),
        }
    )
    changes: tuple[str, ...] = ("ADDS", "REMOVES", "UPDATES", "MOVES")

    def get(self, kind: str) -> Layer:
        return self.known[kind]
