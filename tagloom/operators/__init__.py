"""DataFrame operators, parametrised by column name."""
