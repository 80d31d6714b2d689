"""Table sources, fixture views and sinks."""
from .tables import Shop, load_shop  # noqa: F401
from .sink import write_shop, read_state  # noqa: F401
