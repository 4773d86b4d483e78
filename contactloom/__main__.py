import sys

from contactloom.cli import main

sys.exit(main())
