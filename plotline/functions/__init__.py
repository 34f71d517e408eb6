"""Column -> Column expressions (all built-in Spark SQL functions, no UDFs)."""

from plotline.functions.text import *  # noqa: F401,F403
from plotline.functions.dates import *  # noqa: F401,F403
from plotline.functions.numeric import *  # noqa: F401,F403
from plotline.functions.arrays import *  # noqa: F401,F403
