"""Registered queries (one module per operator family)."""

from . import registry  # noqa: F401
from . import q_calibration  # noqa: F401
from . import q_metrics  # noqa: F401
from . import q_text  # noqa: F401
from . import q_similarity  # noqa: F401
from . import q_agreement  # noqa: F401
from . import q_labels  # noqa: F401
from . import q_filters  # noqa: F401
from . import q_sampling  # noqa: F401
from . import q_reshape  # noqa: F401
from . import q_models  # noqa: F401
from . import q_io  # noqa: F401
from . import q_extra  # noqa: F401
from . import q_exact  # noqa: F401
from . import q_fits  # noqa: F401
from . import q_loops  # noqa: F401
from . import q_prompts  # noqa: F401

REGISTRY = registry.REGISTRY
