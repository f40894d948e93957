"""Every operator as a named query over the given tables, with equivalent SQL."""
