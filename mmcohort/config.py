"""Class, modality and hyper-parameter configuration.

Everything the rest of the package needs to know about the study layout is
declared here once, by name. Code never depends on column positions.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# These must equal the source study pipeline for right results.
# ---------------------------------------------------------------------------

# Target classes, index 0..11, in this order.
CLASS_NAMES = (
    "Fracture",
    "Lung Lesion",
    "Enlarged Cardiomediastinum",
    "Consolidation",
    "Pneumonia",
    "Atelectasis",
    "Lung Opacity",
    "Pneumothorax",
    "Edema",
    "Cardiomegaly",
    "Length-of-Stay",
    "48-hour Mortality",
)
FINDING_COLUMNS = CLASS_NAMES[:10]

# Modalities in the order they are stored in the feature vector, and in the
# order they are fed to the scorer as tokens.
STORED_ORDER = ("vd", "vmd", "ts_ce", "ts_le", "ts_pe", "n_rad")
TOKEN_ORDER = ("vd", "vmd", "ts_pe", "ts_ce", "ts_le", "n_rad")

# Width of each modality in the full-size study table.
STUDY_WIDTHS = {"vd": 1024, "vmd": 1024, "ts_ce": 99, "ts_le": 242, "ts_pe": 110, "n_rad": 768}
LATENT_DIM = 2048

# Column-name prefix of each modality in the wide table.
MODALITY_PREFIX = {
    "vd": "vd_",
    "vmd": "vmd_",
    "ts_ce": "ts_ce_",
    "ts_le": "ts_le_",
    "ts_pe": "ts_pe_",
    "n_rad": "n_rad_",
}

# Columns removed from the wide table by name and by prefix.
DROPPED_COLUMNS = (
    "img_id", "img_charttime", "img_deltacharttime", "discharge_location",
    "img_length_of_stay", "death_status", "split", "No Finding", "Fracture",
    "Lung Lesion", "Enlarged Cardiomediastinum", "Consolidation", "Pneumonia",
    "Atelectasis", "Lung Opacity", "Pneumothorax", "Edema", "Cardiomegaly",
    "Pleural Effusion", "Pleural Other", "Support Devices",
    "PerformedProcedureStepDescription", "ViewPosition",
    "48-hour Mortality", "Length-of-Stay",
)
# Columns removed in the single-label mode.
SINGLE_LABEL_DROPPED = (
    "img_id", "img_charttime", "img_deltacharttime", "discharge_location", "img_length_of_stay", "death_status",
)
DROPPED_PREFIXES = ("de_", "vp_", "vmp_")

# Scorer vocabulary positions read as class logits (one per class).
VOCAB_POSITIONS = (101, 201, 301, 401, 501, 601, 701, 801, 901, 1001, 1101, 1201)

# Asymmetric-loss focusing parameter per class.
GAMMAS_JOINT = (4, 4, 4, 4, 4, 4, 4, 4, 4, 4, 4, 4)
GAMMAS_ISOLATED = (5, 5, 2, 4, 2, 4, 4, 4, 2, 4, 5, 5)

# Loss / split / filter constants.
ASL_CLIP = 0.05
ASL_EPS = 1e-6
DELTA_P_DEFAULT = 0.1
BCE_K = 2
BCE_EPS = 1e-6
BETA = 0.1
BATCH_SIZE = 32
VAL_FRACTION = 0.25
SPLIT_SEED = 23
OUTLIER_LIMIT = 10.0
STAY_HOURS = 48.0
UNCERTAIN_SRC = -1.0
UNCERTAIN_DST = 2.0
NUM_CLASSES = 12
LEARNING_RATE = 1e-4
WEIGHT_DECAY = 1e-5
GRAD_CLIP = 1.0
FIT_SEED = 42
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class ModalitySpec:
    """Names and widths of the modalities of one study table.

    ``widths`` maps modality name -> vector width, in stored order.
    """

    widths: dict = field(default_factory=lambda: dict(STUDY_WIDTHS))
    stored_order: tuple = STORED_ORDER
    token_order: tuple = TOKEN_ORDER
    prefixes: dict = field(default_factory=lambda: dict(MODALITY_PREFIX))

    def offsets(self) -> dict:
        """Half-open [start, end) offsets of each modality in the stored vector."""
        out, start = {}, 0
        for name in self.stored_order:
            out[name] = (start, start + self.widths[name])
            start += self.widths[name]
        return out

    @property
    def total_width(self) -> int:
        return sum(self.widths[m] for m in self.stored_order)


STUDY_SPEC = ModalitySpec()

# Scaled-down layout used by the fixture built over the ``embeddings`` table
# (widths sum to 64, stored order as above).
FIXTURE_SPEC = ModalitySpec(widths={"vd": 16, "vmd": 16, "ts_ce": 8, "ts_le": 12, "ts_pe": 4, "n_rad": 8})
