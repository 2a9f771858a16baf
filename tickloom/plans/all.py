"""Imports every query module so the catalogue is complete."""

from tickloom.plans import bars_calendar  # noqa: F401
from tickloom.plans import joins_sets  # noqa: F401
from tickloom.plans import intraday  # noqa: F401
from tickloom.plans import daily  # noqa: F401
from tickloom.plans import levels  # noqa: F401
from tickloom.plans import options  # noqa: F401
from tickloom.plans import evaluation  # noqa: F401
from tickloom.plans import profile  # noqa: F401
from tickloom.plans import sources  # noqa: F401
from tickloom.plans import streaming  # noqa: F401
from tickloom.plans import flagship  # noqa: F401
