"""Reduce tables of semi-structured records to budgeted views with a ledger of every cut."""
