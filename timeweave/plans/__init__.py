"""From query text to DataFrame: tokens, syntax tree, compiler."""
