"""Importing this module fills the registry."""

from . import analytics  # noqa: F401
from . import dashboard  # noqa: F401,E402
from . import products  # noqa: F401,E402
from . import matching  # noqa: F401,E402
from . import operations  # noqa: F401,E402
from . import data  # noqa: F401,E402
from . import pages  # noqa: F401,E402
from . import streams  # noqa: F401,E402
