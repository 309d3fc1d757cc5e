import sys

from lectern.plans.command import main

sys.exit(main())
