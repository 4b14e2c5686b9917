from curbside.plans.matching import match, match_all, match_cells, match_parts, merged_parts, part_lists

__all__ = ["match", "match_all", "match_cells", "match_parts", "merged_parts", "part_lists"]
