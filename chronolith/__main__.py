"""``python -m chronolith ROOT [STEP ...]``, and the file that spark-submit runs."""

import os
import sys

if __package__ in (None, ""):  # run by path: the package is found beside it
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from chronolith.jobs import main

raise SystemExit(main())
