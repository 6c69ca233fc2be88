"""Entry script for spark-submit; see ``run.py --help``."""

from tidemark.cli import main

if __name__ == "__main__":
    main()
