"""Words that may not be used bare as column names."""

# Reserved words of the SQL dialect whose header clean-up we match.
RESERVED_WORDS = set(
    "all analyse analyze and any array as asc asymmetric both case cast check collate column constraint create default "
    "deferrable desc describe distinct do else end except false fetch for foreign from group having in initially "
    "intersect into lambda lateral leading limit not null offset on only or order pivot pivot_longer pivot_wider placing "
    "primary qualify references returning select show some summarize symmetric table then to trailing true union unique "
    "unpivot using variadic when where window with".split()
)

# Words of that dialect reserved for type and function names.
TYPE_FUNCTION_WORDS = set(
    "anti asof at authorization binary by collation columns concurrently cross freeze full generated glob ilike inner "
    "is isnull join left like map natural notnull outer overlaps positional right semi similar struct tablesample "
    "try_cast tuple unpack verbose".split()
)
