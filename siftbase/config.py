"""Options and model coefficients."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class ModelParams:
    """Coefficients of the published logistic models. Fixed values."""

    snp_intercept: float = -9.088
    snp_quality: float = 0.162
    snp_nqs: float = 1.645
    snp_swap: float = 0.0
    snp_rel_pos: float = 2.349

    indel_intercept: float = -20.5
    indel_entropy: float = 3.39065
    indel_strand: float = 3.02573
    indel_norm_var_sq: float = 0.32695
    indel_nbq: float = 0.37184

    wgs_intercept: float = -14.95535266
    wgs_entropy: float = 0.16228492
    wgs_strand: float = 4.84302146
    wgs_norm_var_sq: float = 0.02302639
    wgs_nbq: float = 0.18140485
    wgs_mapq: float = 0.10577339
    wgs_var_rate: float = -62.03643929

    # Priors by tenth of the evidence probability.
    err_prior: tuple[float, ...] = (0.991, 0.004, 0.002, 0.001, 0.001, 0.001, 0.000002, 0.000005, 0.0000001, 0.000001)
    snp_prior: tuple[float, ...] = (0.0000001, 0.0000001, 0.0000001, 0.0000001, 0.0000001, 0.0000001, 0.0000001, 0.0000001, 0.027, 0.973)
    prior_err: float = 0.1
    prior_snp: float = 0.9


@dataclass(frozen=True)
class CallerOptions:
    """Thresholds and switches. Fixed values as defaults; every one can be set."""

    min_snp_mapq: int = 1
    min_indel_mapq: int = 0
    max_coverage: int = 8000
    coverage_cap: int = 16383
    max_sub: float = 0.05
    max_gap: float = 0.05
    scavenge: bool = True  # equal majorities are told apart by posterior, else by base quality
    all_non_ref: bool = False
    wgs_indel: bool = False
    gvcf: bool = False
    block_abs: int = 3
    block_rel: float = 0.3
    snp_min_p: float = 0.109
    snp_pass_p: float = 0.95
    snp_min_coverage: int = 6
    snp_min_reads: int = 2
    snp_het_min: float = 0.1
    snp_het_max: float = 0.9
    snp_strand_depth: int = 16
    snp_strand_share: float = 0.01
    indel_min_p: float = 0.109
    indel_pass_p: float = 0.5
    indel_min_reads: int = 2
    indel_min_depth: int = 5
    indel_min_ratio: float = 0.06
    indel_hom: float = 0.6
    indel_het: float = 0.06
    max_near_end: float = 0.8
    near_end: int = 3
    strand_filter: bool = False
    legacy_indel_target: bool = False
    skip_advances_snp: bool = True
    force_reads: int | None = None  # keep a site below the threshold with as many alternative reads
    force_fraction: float = 0.0
    models: ModelParams = field(default_factory=ModelParams)

    def __post_init__(self):
        for name in ("min_snp_mapq", "min_indel_mapq"):
            if not 0 <= getattr(self, name) <= 60:
                raise ValueError(f"{name} must be from 0 to 60")
        if self.min_snp_mapq < self.min_indel_mapq:
            raise ValueError("min_snp_mapq must not be below min_indel_mapq")
        if not 0 <= self.max_coverage <= 8191:
            raise ValueError("max_coverage must be from 0 to 8191")

    @property
    def block_label(self) -> str:
        return f"min{int(100 * self.block_rel)}p{int(self.block_abs)}a"
