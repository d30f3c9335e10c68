"""Schemas of the files the engine reads and the labels it normalises."""

# Rubric dimensions, panel sizes and limits used by the study.
DIMENSIONS = ["CA", "CC", "SQ", "LA"]
HUMAN_RATERS = 10
AI_RATERS = 3
HUMAN_WEIGHT = 0.6
ENERGY_FLOOR_J = 0.01
JOULES_PER_KWH = 3.6e6
THROTTLE_MHZ = 2100
TOKEN_CAP = 200
JUDGE_FALLBACK = 7
JUDGE_FALLBACK_REASON = "scoring_failed"
IDLE_SECONDS = 10.0

# Category bands (first position past the band, label).
CATEGORY_BANDS = [
    (100, "Mathematics"),
    (200, "Science"),
    (300, "Programming-CS"),
    (400, "Humanities"),
    (500, "Meta-cognition"),
]

# Spellings found in the result files, keyed by their folded form.
CATEGORY_LABELS = {
    "mathematics": "Mathematics",
    "science": "Science",
    "programming-cs": "Programming-CS",
    "humanities": "Humanities",
    "meta-cognition": "Meta-cognition",
    "metacognition": "Meta-cognition",
}
PRECISION_LABELS = {
    "fp16": "FP16",
    "nf4": "NF4",
    "f16": "F16",
    "f16-gguf": "F16",
    "q4-k-m": "Q4_K_M",
}

# Decimals kept per column when results are written.
ROUNDING = {
    "latency_s": 4,
    "tokens_per_s": 2,
    "gross_energy_j": 4,
    "net_energy_j": 4,
    "power_net_w": 2,
    "lpw": 8,
}


PROMPT_FILE = "ID BIGINT, CATEGORY STRING, PROMPT STRING"

# Result-file variants as DDL. Columns that hold blanks before scoring are read as text.
RESULT_FILES = {
    "gpu": (
        "ID BIGINT, Precision STRING, Category STRING, Prompt STRING, Response STRING, Input_Tokens BIGINT,"
        " Output_Tokens BIGINT, Latency_s DOUBLE, Tokens_per_sec DOUBLE, Gross_Energy_J DOUBLE,"
        " Net_Energy_J DOUBLE, Power_W DOUBLE, use_cache BOOLEAN"
    ),
    "judged": (
        "ID BIGINT, Precision STRING, Category STRING, Prompt STRING, Response STRING, Latency_s DOUBLE,"
        " Net_Energy_J DOUBLE, Power_W DOUBLE, Qped DOUBLE, Score_Reason STRING, LpW DOUBLE"
    ),
    "unscored": (
        "ID BIGINT, Precision STRING, Category STRING, Prompt STRING, Response STRING, Latency_s DOUBLE,"
        " Net_Energy_J DOUBLE, Power_W DOUBLE, Qped STRING, LpW STRING"
    ),
    "laptop": (
        "ID BIGINT, Precision STRING, Category STRING, Prompt STRING, Response STRING, Input_Tokens BIGINT,"
        " Output_Tokens BIGINT, Latency_s DOUBLE, Tokens_per_sec DOUBLE, Platform STRING"
    ),
    "desktop": (
        "ID BIGINT, HW_Platform STRING, Backend STRING, Precision STRING, Category STRING, Prompt STRING,"
        " Response STRING, Output_Tokens BIGINT, Latency_s DOUBLE, Tokens_per_sec DOUBLE, Gross_Energy_J DOUBLE,"
        " Net_Energy_J DOUBLE, Power_W DOUBLE, use_cache BOOLEAN, Q_ped STRING, LpW STRING"
    ),
    "board": (
        "ID BIGINT, HW_Platform STRING, Backend STRING, Precision STRING, Category STRING, Prompt STRING,"
        " Response STRING, Output_Tokens BIGINT, Latency_s DOUBLE, Tokens_per_sec DOUBLE, Gross_Energy_J DOUBLE,"
        " Net_Energy_J DOUBLE, Power_W DOUBLE, CPU_Freq_MHz DOUBLE, CPU_Temp_C DOUBLE, Throttled BOOLEAN,"
        " Q_ped STRING, LpW STRING"
    ),
    "published": (
        "ID BIGINT, HW_Platform STRING, Backend STRING, Precision STRING, Category STRING, Output_Tokens BIGINT,"
        " Latency_s DOUBLE, Gross_Energy_J DOUBLE, Net_Energy_J DOUBLE, Power_W DOUBLE, Q_ped DOUBLE, LpW DOUBLE"
    ),
    "models": (
        "Model STRING, Category STRING, CA INT, CC INT, SQ INT, LA INT, Qped DOUBLE, Latency_s DOUBLE,"
        " Net_Energy_J DOUBLE, LpW DOUBLE, LpW_x1e4 DOUBLE"
    ),
}

# File column -> canonical column.
CANONICAL_NAMES = {
    "ID": "run_id",
    "HW_Platform": "platform",
    "Platform": "platform",
    "Backend": "backend",
    "Model": "model",
    "Precision": "precision",
    "Category": "category",
    "CATEGORY": "category",
    "Prompt": "prompt",
    "PROMPT": "prompt",
    "Response": "response",
    "Input_Tokens": "input_tokens",
    "Output_Tokens": "output_tokens",
    "Latency_s": "latency_s",
    "Tokens_per_sec": "tokens_per_s",
    "Gross_Energy_J": "gross_energy_j",
    "Net_Energy_J": "net_energy_j",
    "Power_W": "power_net_w",
    "CPU_Freq_MHz": "cpu_freq_mhz",
    "CPU_Temp_C": "cpu_temp_c",
    "Throttled": "throttled",
    "Q_ped": "q_ped",
    "Qped": "q_ped",
    "LpW": "lpw",
    "Score_Reason": "score_reason",
}

SUMMARY_STATS = (
    "struct<n:bigint,latency_mean:double,latency_std:double,net_energy_mean:double,power_mean:double,"
    "q_ped_mean:double,lpw_mean:double,tokens_per_sec:double,note:string>"
)
SUMMARY = f"map<string,struct<platform:string,results:map<string,{SUMMARY_STATS}>>>"

SCORING_SHEET = (
    "item_id BIGINT, precision STRING, rater_id BIGINT, CA INT, CC INT, SQ INT, LA INT, Notes STRING"
)
