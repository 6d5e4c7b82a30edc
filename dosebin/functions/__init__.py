from .names import *  # noqa: F401,F403
from .scalars import *  # noqa: F401,F403
from .distributions import *  # noqa: F401,F403
