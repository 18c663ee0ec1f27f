"""Where node tables come from and how they are stored."""
