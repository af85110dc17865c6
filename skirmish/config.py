"""Parameters of the rating engine, passed explicitly to every operator."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Config:
    """Fixed values of the rating model. `with_` gives a changed copy, for tuning."""

    # envelope of all sleeve weights
    sleeve_min: float = 0.80
    sleeve_max: float = 1.20
    # rolling periods: window days, least bouts, least raw bouts with title credit
    five_year: tuple[int, int, int] = (1825, 8, 6)
    ten_year: tuple[int, int, int] = (3650, 13, 10)
    # era and division normalisation
    norm_min_rows: int = 200
    norm_strength: float = 0.50
    norm_std_floor: float = 0.5
    # opponent quality
    pivot: float = 1500.0
    mu_scale: float = 900.0
    opp_weight_max: float = 2.6
    opp_weight_center: float = 0.5
    opp_weight_temp: float = 0.22
    title_weight: float = 1.40
    # appearance weights and result adjustments in a period
    win_base: float = 0.25
    loss_base: float = 0.50
    loss_quality: float = 1.0
    draw_base: float = 0.25
    win_bonus: float = 10.0
    draw_penalty: float = 5.0
    loss_penalty: float = 55.0
    shrink_min: int = 30
    activity_per_bout: float = 0.5
    activity_per_weight: float = 1.0
    activity_cap: float = 50.0
    # win-context bonuses
    title_bout_bonus: float = 8.0
    title_win_bonus: float = 55.0
    interim_win_bonus: float = 35.0
    champion_win_bonus: float = 35.0
    interim_champion_win_bonus: float = 20.0
    top5_bonus: float = 25.0
    top10_bonus: float = 15.0
    top15_bonus: float = 8.0
    p4p5_bonus: float = 25.0
    p4p15_bonus: float = 10.0
    extra_division_bonus: float = 30.0
    title_credit: tuple[float, float, float] = (0.75, 1.00, 0.75)
    title_mass: tuple[float, float, float] = (2.0, 3.0, 2.5)
    resume_rate: float = 2.0
    resume_cap: float = 180.0
    # integrity
    ped_score: float = 0.55
    dq_score: float = 0.75
    weight_score: float = 0.70
    ped_factor: float = 0.80
    dq_factor: float = 0.92
    weight_factor: float = 0.88
    # result scores
    finish_score: float = 1.00
    sweep_score: float = 0.97
    unanimous_score: float = 0.95
    split_score: float = 0.90
    dq_win_score: float = 0.85
    defense_floor: float = 0.990
    interim_defense_floor: float = 0.985
    dominance_amp: float = 0.010
    dominance_scale: float = 2.0
    dominance_floor: float = 0.975
    # performance factors
    decisiveness_amp: float = 0.03
    quality_amp: float = 0.16
    rank_amp: float = 0.16
    title_amp: float = 0.16
    p4p_amp: float = 0.14
    streak_amp: float = 0.05
    upset_amp: float = 0.03
    upset_gap: float = 6.0
    upset_scale: float = 10.0
    unranked: float = 16.0
    upset_odds: tuple[float, float] = (250.0, 700.0)
    tanh_scale: float = 0.20
    rank_top: int = 15
    active_days: int = 1095
    class_up_win: float = 0.05
    class_down_loss: float = 0.05
    class_up_loss: float = 0.10
    odds_up: float = 0.15
    odds_down: float = 0.10
    # layoffs
    gap_normal: int = 270
    gap_full: int = 730
    layoff_amp: float = 0.12
    idle_start: float = 15.0
    idle_full: float = 30.0
    idle_cap: float = 75.0
    # whole-history rating
    whr_w2: float = 4e-4
    whr_prior_var: float = 4.0
    whr_rounds: int = 50
    whr_clip: float = 1.5
    # Glicko-2
    tau: float = 0.5
    mu0: float = 1500.0
    phi0: float = 350.0
    sigma0: float = 0.06
    ratio: float = 173.7178
    days_per_month: float = 30.4375
    # diagnostics
    reliability: float = 8.0
    entropy_top: int = 10
    temperature: float = 100.0
    bins: int = 10
    min_prior: int = 3

    def with_(self, **changes) -> "Config":
        return replace(self, **changes)


DEFAULT = Config()

#: Standard divisions and their limits in pounds; labels that contain others come first.
LIMITS = {
    "Women's Strawweight": 115,
    "Women's Flyweight": 125,
    "Women's Bantamweight": 135,
    "Women's Featherweight": 145,
    "Light Heavyweight": 205,
    "Flyweight": 125,
    "Bantamweight": 135,
    "Featherweight": 145,
    "Lightweight": 155,
    "Welterweight": 170,
    "Middleweight": 185,
    "Heavyweight": 265,
}

#: Rating streams; sleeved ones carry appearance weights.
GLICKO_STREAMS = ("canonical", "method", "method_integrity", "method_performance", "method_integrity_performance")
WHR_STREAMS = ("whr", "whr_integrity", "whr_performance", "whr_integrity_performance")
