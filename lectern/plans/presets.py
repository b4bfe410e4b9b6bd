"""Quality presets: which gates run, and their thresholds."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class QualityConfig:
    # fixed values: the balanced preset
    mode: str = "balanced"
    use_capsule_pooling: bool = True
    use_source_grounded_skeletons: bool = True
    use_anchor_driven_drafting: bool = True
    use_verification_loop: bool = True
    use_ambiguity_gate: bool = False
    use_novelty_gate: bool = True
    use_controlled_distractors: bool = True
    max_repair_attempts: int = 2
    reject_on_weak_grounding: bool = True
    capsule_pool_size: int = 80
    chunks_per_item: int = 6
    min_chunks_per_item: int = 4
    evidence_coverage_threshold: float = 0.95
    quote_verification_threshold: float = 0.90
    novelty_similarity_threshold: float = 0.85


BALANCED = QualityConfig()
FAST = replace(
    BALANCED, mode="fast", use_source_grounded_skeletons=False, use_anchor_driven_drafting=False,
    use_verification_loop=False, use_novelty_gate=False, use_controlled_distractors=False,
    max_repair_attempts=0, reject_on_weak_grounding=False,
)
STRICT = replace(
    BALANCED, mode="strict", use_ambiguity_gate=True, max_repair_attempts=3,
    evidence_coverage_threshold=0.98, quote_verification_threshold=0.95,
)
PRESETS = {"fast": FAST, "balanced": BALANCED, "strict": STRICT}


def preset(mode: str) -> QualityConfig:
    if mode not in PRESETS:
        raise ValueError(f"unknown mode {mode!r}, expected one of {sorted(PRESETS)}")
    return PRESETS[mode]
