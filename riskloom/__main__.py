import sys

from .plans.config import main

sys.exit(main())
