"""assay: a PySpark-native engine that tries to disprove a trading signal."""

from assay.operators.portfolio import Spec
from assay.operators.universe import Universe
from assay.operators.walkforward import make_windows, walk_forward
from assay.prereg import Criteria, registered
from assay.report import Demand, Finding, Report
from assay.study import Attack, Case, Study

__version__ = "0.1.0"
__all__ = ["Attack", "Case", "Criteria", "Demand", "Finding", "Report", "Spec", "Study", "Universe", "make_windows", "registered", "walk_forward"]
