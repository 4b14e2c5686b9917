from curbside.functions.decode import decode_clients, decode_taxis
from curbside.functions.grid import Grid
from curbside.functions.plane import distance, normalize_lon

__all__ = ["Grid", "decode_clients", "decode_taxis", "distance", "normalize_lon"]
