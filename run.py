"""Command line: ``spark-submit --py-files tallyframe.zip run.py <analysis> <arguments>``."""

import sys

from tallyframe.plans import classify, explore, quality, store

PLANS = {"store": store, "quality": quality, "explore": explore, "classify": classify}

if __name__ == "__main__":
    if len(sys.argv) < 2 or sys.argv[1] not in PLANS:
        sys.exit(f"usage: run.py {{{','.join(PLANS)}}} ...")
    PLANS[sys.argv[1]].main(sys.argv[2:])
