"""Defaults of the jobs (fixed values: model names, pools, fold counts and search sizes)."""

LABEL = "Class"
V_COLUMNS = [f"V{i}" for i in range(1, 29)]
RAW_COLUMNS = ["Time", *V_COLUMNS, "Amount", LABEL]
DROPPED_COLUMNS = ["Amount", "Time"]
SCALED_COLUMNS = ["Log_Amount"]

K_BEST = 20
CV_SPLITS = 10
CV_REPEATS = 10
DSEL_SIZE = 0.15
BENCHMARK_SPLITS = 5

TUNING_CANDIDATES = 30
TUNING_FACTOR = 3
VALIDATION_SIZE = 0.20
VALIDATION_SPLITS = 1
TUNING_SCORE = "f1"

REGION_SIZE = 8
SEED = 42
RESAMPLING_METHOD = None

BASE_MODELS = [
    "DecisionTreeClassifier", "RandomForestClassifier", "ExtraTreesClassifier",
    "BalancedRandomForestClassifier", "RUSBoostClassifier", "XGBClassifier",
    "AdaBoostClassifier", "LogitBoostClassifier", "MLPClassifier", "SVC",
    "KNeighborsClassifier",
]

STATIC_MODELS = ["VotingClassifier", "VotingClassifier_weighted"]

DYNAMIC_MODELS = [
    "APosteriori", "APriori", "LCA", "MLA", "OLA", "DESClustering", "DESP", "DESKNN",
    "KNOP", "KNORAE", "KNORAU", "RRC", "DESKL", "Exponential", "Logarithmic",
    "StackedClassifier",
]

POOLS = {
    "compact": ["RandomForestClassifier", "XGBClassifier", "SVC", "MLPClassifier"],
    "full_diversity": [
        "RandomForestClassifier", "ExtraTreesClassifier", "BalancedRandomForestClassifier",
        "AdaBoostClassifier", "XGBClassifier", "SVC", "KNeighborsClassifier", "MLPClassifier",
    ],
    "boost_heavy": [
        "RandomForestClassifier", "ExtraTreesClassifier", "AdaBoostClassifier",
        "XGBClassifier", "RUSBoostClassifier",
    ],
}
