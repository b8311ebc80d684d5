import sys

from tessera.plans.cli import main

sys.exit(main())
