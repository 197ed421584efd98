"""``python -m starloom COMMAND ...``."""

import sys

from .commands import main

sys.exit(main())
