"""Fixed values of the measurement. They must equal the published ones for right results."""

# thresholds
MIN_CLIP_S = 60.0
UNREADABLE_CEILING = 0.10
DEBOUNCE_S = 0.5
SPECTRAL_FALSE_ALARM_RATE = 0.05
COVERAGE_FLOOR = 0.60
FLOW_NULL_CEILING = 0.10
DECODE_FAILURE_CEILING = 0.01
LABEL_SHORTFALL_CEILING = 0.01
CONFLICT_CEILING = 0.10
MIN_SCORED_SAMPLES = 8
# rates
ANALYSIS_HZ = 4.0
KEY_QUANTUM_S = 1e-4
# bootstrap and disclosure
BOOTSTRAP_B = 10_000
BOOTSTRAP_SEED = 777
K_FACTORIES_FLOOR = 5
K_WORKERS_FLOOR = 50
MAX_FACTORY_SHARE = 0.40
DESIGN_EFFECT_MC_BAND = 0.05
QUANTILES = (10, 50, 90)
# scales
HAL_ROUNDING = 0.05
HAND_BREADTH_MM = 85.0
RADWIN_F_HZ = (0.125, 1.67)
AKKAS_S_MM = (255.3, 1288.0)
AKKAS_D_PCT = (11.0, 100.0)
# gates
H1A_MAX = 0.05
H1B_MAX = 0.02
H2A_MAX = 0.20
H2B_MIN = 0.70
# gain curve
KNEE_GAIN = 0.90
COLLAPSE_GAIN = 0.50
FLOOR_RATIO = 0.5
TRACK_BAND = 0.25
# disclosure patterns
IDENTIFIER = r"(?i)(factory|worker)[_-]?\d{2,}"
PLACEHOLDER = r"\b(TBD|TODO|FIXME|XXX)\b"
# closed sets
MASK_SOURCES = ("100doh", "egohos")
CLAIM_STATES = ("UNTESTED", "HOLDS", "FAILED", "UNTESTED_ARM_B")
