"""Numeric plans on the driver over what DataFrame jobs return, and the registered queries."""
