from . import ids, paths, vectors

__all__ = ["ids", "paths", "vectors"]
