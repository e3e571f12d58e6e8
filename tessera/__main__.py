"""python -m tessera RAW OUT: all reports from raw files."""

import sys

from tessera.plans.full_run import run
from tessera.session import local_session

if __name__ == "__main__":
    if len(sys.argv) != 3:
        sys.exit(__doc__)
    run(local_session(), sys.argv[1], sys.argv[2])
