"""Parameters that change results.

Everything here is a plain value so callers can override per run.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# --- fixed values (must equal the original trainer's for equal results) ---
GROUP_SIZE = 12                     # completions per prompt (other configs: 8)
ACCURACY_WEIGHT = 1.0
FORMAT_WEIGHT = 1.0
FLAT_GROUP_STD = 0.1                # keep a group iff population std >= this
ADVANTAGE_EPS = 1e-4                # (r - mean) / (std + eps)
MAX_NUM_SEQ = 192                   # sequences in flight (48 x 4)
INT_NUM = 256                       # records per cycle
REP_NUM = 1                         # repeats of the buffer
BETA = 0.0
EPSILON_LOW = 0.2
EPSILON_HIGH = 0.28
KL_ESTIMATOR = "k2"
STUTTER_MIN_REPEAT = 3
STUTTER_MAX_LEN = 5
COSINE_MIN_WRONG = -1.0
COSINE_MAX_WRONG = -0.5
COSINE_MIN_CORRECT = 0.5
COSINE_MAX_CORRECT = 1.0
COSINE_MAX_LEN = 1000
ROLLING_WINDOW = 5
PER_DEVICE_BATCH = 4
GRAD_ACCUM = 4
NUM_DEVICES = 4
MASKED_EPS = 1e-4                   # masked mean / mean KL epsilon
ZSCORE_EPS = 1e-4
ASSISTANT_TOKEN = "assistant"

SYSTEM_PROMPT = (
    "This is a conversation between the User and the Assistant. "
    "The User asks a question, and the Assistant provides a solution. "
    "Before giving the answer, the Assistant first thinks through the reasoning process internally. "
    "The reasoning process is enclosed within <think> </think> tags, "
    "while the final answer is enclosed within <answer> </answer> tags. "
    "The response format is as follows:\n"
    "<think>\nReasoning process here\n</think>\n"
    "<answer>\nAnswer: \\boxed{answer}\n</answer>"
)
# --- end of fixed values ---


@dataclass(frozen=True)
class RunConfig:
    """One run's settings; defaults are the default trainer configuration."""

    group_size: int = GROUP_SIZE
    weights: dict = field(default_factory=lambda: {"accuracy": ACCURACY_WEIGHT,
                                                   "format": FORMAT_WEIGHT})
    flat_group_std: float = FLAT_GROUP_STD
    advantage_eps: float = ADVANTAGE_EPS
    max_num_seq: int = MAX_NUM_SEQ
    int_num: int = INT_NUM
    rep_num: int = REP_NUM
    beta: float = BETA
    epsilon_low: float = EPSILON_LOW
    epsilon_high: float = EPSILON_HIGH
    kl_estimator: str = KL_ESTIMATOR
    per_device_batch: int = PER_DEVICE_BATCH
    grad_accum: int = GRAD_ACCUM
    num_devices: int = NUM_DEVICES
    start_idx: int = 0
    seed: int = 42

    @property
    def prompts_per_batch(self) -> int:
        """Prompts scored together: MAX_NUM_SEQ // G."""
        return self.max_num_seq // self.group_size

    @property
    def steps_per_cycle(self) -> int:
        """Optimiser steps per cycle."""
        return (self.int_num * self.rep_num) // (
            self.per_device_batch * self.grad_accum * self.num_devices)
