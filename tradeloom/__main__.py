import sys

from .runs import main

sys.exit(main())
