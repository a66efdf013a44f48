"""Write every output of the analysis for one application table.

usage: spark-submit [--py-files riskframe.zip] scripts/report.py SOURCE OUT_DIR [QUERY ...]

See ``riskframe/plans/report.py`` for the accepted sources.
"""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from riskframe.plans.report import main  # noqa: E402

if __name__ == "__main__":
    main(sys.argv[1:])
