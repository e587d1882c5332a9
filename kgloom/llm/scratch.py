"""Written tables in the shared folder."""

from ..scratch import Scratch, shared_root

__all__ = ["Scratch", "shared_root"]
