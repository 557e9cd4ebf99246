from wavespan.functions.na import *  # noqa: F401,F403
from wavespan.functions.na import __all__  # noqa: F401
