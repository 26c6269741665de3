"""Table schemas and the fixed values of the activity data model."""

from __future__ import annotations

from pyspark.sql import types as T

# ---- fixed values -----------------------------------------------------------
TARGET_IDS = ["CHEMBL220", "CHEMBL4822", "CHEMBL3177"]
NANOMOLAR = "nM"
IMPUTE_LOW, IMPUTE_HIGH = 0.01, 1e6
FINGERPRINT_BITS = 2048
SPLIT_SEED = 42
TEST_SIZE, VAL_SIZE = 0.1, 0.1
PATIENCE, MIN_DELTA, BATCH_SIZE = 12, 1e-4, 64

NUMERIC_FEATURES = [
    "mw_freebase", "alogp", "hba", "hbd", "psa", "rtb", "aromatic_rings",
    "qed_weighted", "confidence_score", "standard_value", "pIC50",
]
VIF_FEATURES = NUMERIC_FEATURES[:8]
PCA_FEATURES = NUMERIC_FEATURES[:7]
BOX_FEATURES = ["standard_value", "pIC50", "mw_freebase", "alogp", "hba", "hbd", "psa", "rtb"]

ATOMIC_NUMBERS = [1, 5, 6, 7, 8, 9, 14, 15, 16, 17, 34, 35, 53]
HYBRIDIZATIONS = ["SP", "SP2", "SP3", "SP3D", "SP3D2"]
CHIRAL_TAGS = ["CHI_UNSPECIFIED", "CHI_TETRAHEDRAL_CW", "CHI_TETRAHEDRAL_CCW"]
BOND_TYPES = ["SINGLE", "DOUBLE", "TRIPLE", "AROMATIC"]
BOND_STEREO = ["STEREONONE", "STEREOZ", "STEREOE", "STEREOCIS", "STEREOTRANS"]

RESULT_KEY = [
    "model", "split", "seed", "pooling", "gnn_hidden_dim",
    "gnn_num_layers", "gnn_dropout", "lr", "weight_decay",
]
GRID_KEY = ["lr", "weight_decay", "pooling", "gnn_hidden_dim", "gnn_num_layers", "gnn_dropout"]
REPORT_COLUMNS = [
    "model", "split", "seed", "epochs", "epochs_trained", "best_epoch", "lr", "batch_size",
    "weight_decay", "pooling", "gnn_hidden_dim", "gnn_num_layers", "gnn_dropout",
    "avg_train_loss", "avg_val_loss", "best_val_loss", "r2_val", "r2_test",
    "from_cache", "cache_path",
]
CONFIG_FIELDS = [
    "model_type", "split_type", "seed", "epochs", "lr", "batch_size",
    "early_stopping_patience", "min_delta", "weight_decay", "pooling",
    "gnn_hidden_dim", "gnn_num_layers", "gnn_dropout",
]
EPOCH_METRICS = ["train_loss", "val_loss", "val_r2", "lr"]
# -----------------------------------------------------------------------------


_TYPES = {
    "bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(),
    "boolean": T.BooleanType(), "map<string,string>": T.MapType(T.StringType(), T.StringType()),
    "map<string,double>": T.MapType(T.StringType(), T.DoubleType()),
}


def _struct(columns: str) -> T.StructType:
    """Schema of 'name type, name type' without a running session."""
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in (c.split(" ") for c in columns.split(", "))])


SOURCE_SCHEMAS = {
    "activities": _struct(
        "activity_id bigint, assay_id bigint, molregno bigint, standard_value double, "
        "standard_units string, standard_type string, standard_relation string, "
        "pchembl_value double, potential_duplicate int"
    ),
    "assays": _struct("assay_id bigint, tid bigint, confidence_score int"),
    "target_dictionary": _struct("tid bigint, chembl_id string, pref_name string"),
    "compound_structures": _struct("molregno bigint, canonical_smiles string"),
    "compound_properties": _struct(
        "molregno bigint, mw_freebase double, alogp double, hba int, hbd int, psa double, "
        "rtb int, aromatic_rings int, qed_weighted double"
    ),
}

ACTIVITY_SCHEMA = _struct(
    "activity_id bigint, molregno bigint, canonical_smiles string, mw_freebase double, "
    "alogp double, hba int, hbd int, psa double, rtb int, aromatic_rings int, "
    "qed_weighted double, standard_value double, standard_units string, standard_type string, "
    "standard_relation string, pchembl_value double, target_chembl_id string, "
    "target_name string, confidence_score int, pIC50 double"
)

EPOCH_SCHEMA = _struct(
    "run_id string, epoch int, train_loss double, val_loss double, val_r2 double, lr double"
)

RESULT_SCHEMA = _struct(
    "model string, split string, seed int, epochs int, epochs_trained int, best_epoch int, "
    "lr double, batch_size int, weight_decay double, pooling string, gnn_hidden_dim int, "
    "gnn_num_layers int, gnn_dropout double, avg_train_loss double, avg_val_loss double, "
    "best_val_loss double, r2_val double, r2_test double, device string, "
    "amp_enabled boolean, from_cache boolean, cache_path string"
)

RUN_SCHEMA = _struct(
    "run_name string, tags map<string,string>, params map<string,string>, "
    "metrics map<string,double>"
)
