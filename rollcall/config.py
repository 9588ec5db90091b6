"""Run configuration: reward toggles, weights, ranges, length limits.

Fixed values (must equal the reference run configuration for equal scores).
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# --- fixed values -----------------------------------------------------------
# Reward component names, in the order the composite evaluates them.
COMPONENTS = (
    "format_reward",
    "syntax_execution_reward",
    "result_reward",
    "schema_linking_reward",
    "ngram_similarity_reward",
    "thinking_quality_reward",
    "llm_judge_reward",
)
# Score range of each component: (min, max).
RANGES = {
    "format_reward": (-1.5, 2.0),
    "syntax_execution_reward": (-2.0, 2.0),
    "result_reward": (-3.0, 3.0),
    "schema_linking_reward": (0.0, 2.0),
    "ngram_similarity_reward": (0.0, 2.0),
    "thinking_quality_reward": (0.0, 2.0),
    "llm_judge_reward": (0.0, 2.0),
}
# Weights of the NL2SQL run configuration.
RUN_WEIGHTS = {
    "format_reward": 0.30,
    "syntax_execution_reward": 0.20,
    "result_reward": 1.00,
    "schema_linking_reward": 0.30,
    "ngram_similarity_reward": 0.30,
    "thinking_quality_reward": 0.15,
    "llm_judge_reward": 0.20,
}
# Which components the NL2SQL run enables.
RUN_ENABLED = {
    "format_reward": False,
    "syntax_execution_reward": True,
    "result_reward": True,
    "schema_linking_reward": True,
    "ngram_similarity_reward": True,
    "thinking_quality_reward": False,
    "llm_judge_reward": False,
}
MAX_SEQ_LENGTH = 2100
MAX_PROMPT_LENGTH = 900
MAX_COMPLETION_LENGTH = 1050
NUM_GENERATIONS = 4
MAX_STEPS = 500
# --- end fixed values -------------------------------------------------------


@dataclass(frozen=True)
class RewardConfig:
    """Which components are on and how they are weighted.

    Unlike the reference, every toggle is explicit (no per-component
    defaults) and switching off the syntax reward is honoured.
    """

    enabled: dict = field(default_factory=lambda: dict(RUN_ENABLED))
    weights: dict = field(default_factory=lambda: dict(RUN_WEIGHTS))
    num_generations: int = NUM_GENERATIONS
    #: Registered rewards: name -> (score column, (min, max)).
    extra: dict = field(default_factory=dict)
    #: Rewards computed by functions (``operators.reward_functions``).
    functions: tuple = ()

    def with_reward(self, name: str, score_col: str, span: tuple[float, float], weight: float = 1.0,
                    enabled: bool = True) -> "RewardConfig":
        """A configuration with one more reward: its score column (any Column
        or pandas_udf added to the frame), its range and its weight. It joins
        the composite, the breakdown and the dominance check."""
        if name in COMPONENTS or name in self.extra:
            raise ValueError(f"reward {name} exists")
        if not span[0] < span[1]:
            raise ValueError(f"reward {name} needs a range")
        return replace(self, enabled={**self.enabled, name: enabled}, weights={**self.weights, name: weight},
                       extra={**self.extra, name: (score_col, span)})

    def components(self) -> list[str]:
        return [*COMPONENTS, *self.extra]

    def span(self, name: str) -> tuple[float, float]:
        return self.extra[name][1] if name in self.extra else RANGES[name]

    def disabled_components(self) -> list[str]:
        return [c for c in self.components() if not self.on(c)]

    def on(self, name: str) -> bool:
        return bool(self.enabled.get(name, False))

    def weight(self, name: str) -> float:
        return float(self.weights.get(name, 0.0))

    def enabled_components(self) -> list[str]:
        return [c for c in self.components() if self.on(c)]


@dataclass(frozen=True)
class LengthLimits:
    max_seq_length: int = MAX_SEQ_LENGTH
    max_prompt_length: int = MAX_PROMPT_LENGTH
    max_completion_length: int = MAX_COMPLETION_LENGTH
